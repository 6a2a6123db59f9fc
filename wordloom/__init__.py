"""wordloom: vocabulary mining and text analytics as lazy Spark plans."""
