"""Tags: canonical names, the dotted hierarchy, the three states of a tag's value, interest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Interest by rising priority.
INTEREST = ("neutral", "uninteresting", "interesting")


# What a definition's scope and interest may be, and the parts of speech that have longer names.
SCOPES = ("book", "word")
POS_NAMES = {"intj": "interjection", "prep": "preposition", "pron": "pronoun", "conj": "conjunction", "num": "numeral", "det": "determiner"}


def pos_label(pos: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in POS_NAMES.items() for x in pair])[pos], pos)


def valid_scope(scope: Column) -> Column:
    return F.coalesce(scope.isin(*SCOPES), F.lit(False))


def valid_interest(interest: Column) -> Column:
    return F.coalesce(interest.isin(*INTEREST), F.lit(False))


def valid_source(source: Column, known: tuple[str, ...]) -> Column:
    """Whether a catalogue is one of the known ones."""
    return F.coalesce(source.isin(*known), F.lit(False))


def valid_source_id(source_id: Column) -> Column:
    """Whether an id of a catalogue can stand in a path: letters, digits, and - _ . / but no '..'."""
    return F.coalesce(source_id.rlike(r"^[A-Za-z0-9/_.-]{1,200}$") & ~F.contains(source_id, F.lit("..")), F.lit(False))


def sanitize_tag(name: Column) -> Column:
    """The canonical form of a tag name, null if it is no usable tag: 1 to 4 dotted segments of a-z, 0-9, spaces and
    dashes, 1 to 30 characters each with a letter; pick heads nothing, star has no children."""
    segments = F.transform(F.split(F.lower(F.trim(name)), r"\."), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 -]", ""), " +", " ")))
    good = F.forall(segments, lambda s: F.length(s).between(1, 30) & s.rlike("[a-z]"))
    head = F.try_element_at(segments, F.lit(1))
    reserved = (head == "pick") | ((head == "star") & (F.size(segments) > 1))
    return F.when((F.size(segments) <= 4) & good & ~reserved, F.array_join(segments, "."))


def ancestor_names(name: Column) -> Column:
    """All proper ancestors of a dotted tag, outermost first; none for contextual pick: tags."""
    segments = F.split(name, r"\.")
    n = F.when(name.startswith("pick:"), 0).otherwise(F.size(segments) - 1)
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "."))
    )


def self_and_ancestors(name: Column) -> Column:
    return F.array_append(ancestor_names(name), name)


def sanitize_section(text: Column, most: int = 40) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}\s-]", ""), r"\s+", " ")), 1, most)


def applied(value: Column) -> Column:
    """A value of null is on, 0 considered and declined, 1 or more a level."""
    return F.coalesce(value, F.lit(1)) >= 1


def tag_level(value: Column) -> Column:
    return F.when(value >= 1, value)


def value_code(value: Column) -> Column:
    """null as -1, so that states can be compared and stored without nulls."""
    return F.coalesce(value, F.lit(-1))


def interest_rank(interest: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, INTEREST)), interest), F.lit(1)) - 1


def interest_place(interest: Column) -> Column:
    """Interesting first, then neutral, then uninteresting."""
    return F.when(interest == "interesting", 0).when(interest == "uninteresting", 2).otherwise(1)


def sanitize_book_tag(name: Column) -> Column:
    """The canonical form of a book's tag, null if it is none: a tag name, or two with one colon between them."""
    lowered = F.lower(F.trim(name))
    halves = F.split(lowered, ":", 2)
    both = F.concat(sanitize_tag(halves[0]), F.lit(":"), sanitize_tag(F.try_element_at(halves, F.lit(2))))
    clean = F.when(F.regexp_count(lowered, F.lit(":")) > 1, None).when(F.contains(lowered, F.lit(":")), both).otherwise(sanitize_tag(lowered))
    return F.when(F.length(clean) <= 60, clean)


def interest_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, INTEREST)), (F.coalesce(rank, F.lit(0)) + 1).cast("int"))


def source_tag(source: Column) -> Column:
    """The automatic book tag of a source."""
    return F.when(source.isNotNull() & (source != ""), F.concat(F.lit("src:"), F.lower(source)))


def format_tag(fmt: Column) -> Column:
    return F.when(fmt.isin("epub", "pdf", "txt"), F.concat(F.lit("fmt:"), fmt))
