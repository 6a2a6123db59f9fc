"""Queries over words: histograms, frequencies, the dictionary, roots, candidates, exclusions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wordloom.functions import text as T
from wordloom.operators import frequency, lemma, scoring
from wordloom.plans import standin as S

QUERIES, ORACLES = {}, {}
#: Fixed value: the candidates of a book that the reference's page asks for.
PAGE = 400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOKENS = """tok AS (SELECT source AS book, doc_id, lang, unnest(regexp_extract_all(lower(replace(regexp_replace(text, '\\s+', ' ', 'g'), '’', '''')), '[a-z]+(?:[''’-][a-z]+)*')) AS token FROM documents),
cnt AS (SELECT book, token, count(*) AS n FROM tok GROUP BY ALL)"""
SURFACE = """sur AS (SELECT d.doc_id, d.lang, l.toxic, unnest(regexp_extract_all(text, '[A-Za-z]+(?:[''-][A-Za-z]+)*')) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
bylang AS (SELECT lower(t) AS token, lang, count(*) AS c, sum((t = lower(t))::INT)::BIGINT AS lc, min(toxic) AS toxic FROM sur GROUP BY ALL),
frq AS (SELECT token, sum(c)::BIGINT AS c, sum(lc)::BIGINT AS lc, min(toxic) AS toxic, arg_min(lang, (-c, lang)) AS ety FROM bylang GROUP BY token),
wfr AS (SELECT *, (c - lc) / c AS cap, c * 1e6 / (SELECT sum(c) FROM frq) AS pm FROM frq)"""
WORDS = (
    SURFACE
    + """,
knw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+(?:[''’-][a-z]+)*')) AS token FROM benchmark),
wrd AS (SELECT token AS word, c, cap, pm, pm * lc / c AS pm_lc, ety, length(regexp_replace(token, '[^\\p{L}]', '', 'g')) AS len, regexp_matches(token, '^[a-z]+$') AS alpha,
  list_aggregate(list_sort(list_distinct(regexp_extract_all(token, '[jkqxz]'))), 'string_agg', '') AS rare, len(regexp_extract_all(token, '[aeiouy]+')) AS syl,
  (token IN (SELECT token FROM knw) OR c >= 2) AS wikt, coalesce(toxic = 1, false) AS off, regexp_matches(token, '(able|ible|ish|al|ous)$') AS adj FROM wfr)"""
)
_RULES = ", ".join(f"({r}, '{s}', {k}, '{e}')" for r, (s, ends) in enumerate(lemma.RULES) for k, e in enumerate(ends))


def lemma_sql(level: int) -> str:
    """CTEs stp{level} (word, next), roo{level} (word, root), fam{level} (root, pm, pm_lc, n)."""
    only = "AND suf IN (" + ", ".join(f"'{s}'" for s in lemma.INFLECTIONAL) + ")" if level == 1 else ""
    hops = "".join(
        f"hop{level}_{i} AS (SELECT h.word, CASE WHEN s.next IS NOT NULL AND NOT list_contains(h.seen, s.next) THEN s.next ELSE h.root END AS root, CASE WHEN s.next IS NOT NULL AND NOT list_contains(h.seen, s.next) THEN list_append(h.seen, s.next) ELSE h.seen END AS seen FROM hop{level}_{i - 1} h LEFT JOIN stp{level} s ON h.root = s.word),\n"
        for i in range(1, lemma.MAX_STEPS + 1)
    )
    return f"""rul{level}(r, suf, k, fin) AS (VALUES {_RULES}),
try{level} AS (SELECT w.word, r, k, suf, left(w.word, (length(w.word) - length(suf))::INT) || fin AS base FROM wrd w, rul{level} WHERE alpha AND ends_with(w.word, suf) AND length(w.word) > length(suf) + 1 {only}),
stp{level} AS (SELECT t.word, arg_min(t.base, (t.r, -b.pm, t.k)) AS next FROM try{level} t JOIN wrd b ON t.base = b.word AND b.alpha
  WHERE t.base <> t.word AND length(t.base) >= 3 AND (suf NOT IN ('er', 'ier', 'iest') OR b.adj) GROUP BY t.word),
hop{level}_0 AS (SELECT word, word AS root, [word] AS seen FROM wrd WHERE alpha),
{hops}roo{level} AS (SELECT word, root FROM hop{level}_{lemma.MAX_STEPS}),
fam{level} AS (SELECT root, sum(pm) AS pm, sum(pm_lc) AS pm_lc, count(*) AS n FROM roo{level} JOIN wrd USING (word) GROUP BY root HAVING count(*) >= 2)"""


def _common(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


def candidates_sql(level: int) -> str:
    """CTE can{level} of a level's candidates."""
    rep = f"SELECT c.book, coalesce(r.root, c.token) AS word, c.n FROM cnt c JOIN wrd w ON c.token = w.word AND w.alpha LEFT JOIN roo{level} r ON r.word = c.token" if level else "SELECT c.book, c.token AS word, c.n FROM cnt c JOIN wrd w ON c.token = w.word AND w.alpha"
    fam = f"LEFT JOIN fam{level} f ON f.root = w.word" if level else ""
    used = "CASE WHEN f.root IS NOT NULL THEN f.pm_lc ELSE w.pm_lc END" if level else "w.pm_lc"
    return f"""grp{level} AS (SELECT book, word, sum(n)::BIGINT AS in_book, count(*) AS n_forms FROM ({rep}) GROUP BY ALL),
fea{level} AS (SELECT g.*, w.* EXCLUDE (word), {used} AS used FROM grp{level} g JOIN wrd w ON g.word = w.word {fam}),
par{level} AS (SELECT *, CASE WHEN used IS NULL THEN 4.0::DOUBLE WHEN used <= 0 THEN 5.0 ELSE greatest(0.0::DOUBLE, least(5.0::DOUBLE, -log10(used))) END AS s_r, ln(1.0::DOUBLE + in_book) AS s_s,
  CASE WHEN ety IS NOT NULL AND ety <> '' AND ety NOT IN ({_common(scoring.COMMON_ORIGINS)}) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS s_o,
  0.5::DOUBLE * coalesce(length(rare), 0) + CASE WHEN len BETWEEN 6 AND 13 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN syl BETWEEN 3 AND 5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS s_a
  FROM fea{level} WHERE wikt AND NOT off AND coalesce(cap <= 0.5, true) AND len >= 3 AND coalesce(used <= 12.0, true)),
can{level} AS (SELECT book, {level} AS level, word, in_book, n_forms, score, round(s_r, 9) AS s_rarity, round(s_s, 9) AS s_salience, round(s_o, 9) AS s_origin, round(s_a, 9) AS s_aesthetic,
  row_number() OVER (PARTITION BY book ORDER BY score DESC, word) AS rank FROM (SELECT *, round(1.0::DOUBLE * s_r + 0.6::DOUBLE * s_s + 1.5::DOUBLE * s_o + 0.5::DOUBLE * s_a, 9) AS score FROM par{level}))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


@query(with_(TOKENS) + "SELECT book, token, n AS count FROM cnt")
def token_histogram(spark, sf_dir):
    return S.book_counts(spark, sf_dir)


@query(with_(TOKENS, SURFACE) + "SELECT c.book, sum(n)::BIGINT AS n_tokens, count(*) AS n_types, count(f.token) AS n_matched FROM cnt c LEFT JOIN frq f ON c.token = f.token GROUP BY 1")
def book_totals(spark, sf_dir):
    known = S.frequencies(S.surface(spark, sf_dir)).select("token", F.lit(1).alias("m"))
    joined = S.book_counts(spark, sf_dir).join(known, "token", "left")
    return joined.groupBy("book").agg(F.sum("count").alias("n_tokens"), F.count("*").alias("n_types"), F.count("m").alias("n_matched"))


@query(
    """WITH h AS (SELECT doc_id, source, sha256(coalesce(list_aggregate(regexp_extract_all(lower(text), '[a-z]+(?:[''’-][a-z]+)*'), 'string_agg', ' '), '')) AS h FROM documents)
SELECT h AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM h GROUP BY h HAVING count(*) > 1"""
)
def content_hash_dups(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(
    r"""WITH p AS (SELECT doc_id, source AS book, string_split(regexp_replace(replace(regexp_replace(text, '\s+', ' ', 'g'), '’', ''''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents),
s AS (SELECT doc_id, book, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM p),
t AS (SELECT *, unnest(regexp_extract_all(lower(sentence), '[a-z]+(?:[''’-][a-z]+)*')) AS token FROM s),
f AS (SELECT book, token, count(*) AS n, trim(arg_min(sentence, (doc_id, i))) AS x FROM t GROUP BY ALL),
m AS (SELECT *, regexp_extract(' ' || x || ' ', '(?i)[^a-z]' || token || '[^a-z]') AS hit FROM f),
w AS (SELECT *, CASE WHEN hit = '' THEN -1 ELSE strpos(' ' || x || ' ', hit) - 1 END AS start, greatest(0, (280 - length(token)) // 2) AS half FROM m),
h AS (SELECT *, least(length(x), greatest(start - half, 0) + 280) AS high FROM w)
SELECT book, token, n AS count, CASE WHEN length(x) <= 280 THEN x WHEN start < 0 THEN rtrim(left(x, 280)) || '…'
  ELSE CASE WHEN high > 280 THEN '…' ELSE '' END || trim(substr(x, greatest(0, high - 280) + 1, high - greatest(0, high - 280))) || CASE WHEN high < length(x) THEN '…' ELSE '' END END AS example FROM h"""
)
def sentence_examples(spark, sf_dir):
    """Every token of every book, with its first sentence; a long one is cut around the token."""
    return frequency.histogram(S.table(spark, sf_dir, "documents"))


@query(with_(SURFACE) + "SELECT token, c AS count, lc AS count_lc, round(cap, 9) AS cap_ratio FROM wfr")
def surface_freq(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents").select(F.explode(T.surface_tokens(F.col("text"))).alias("token"))
    return frequency.case_folded(docs).withColumn("cap_ratio", F.round("cap_ratio", 9))


@query(with_(SURFACE) + "SELECT token, c AS count, round(pm, 6) AS pm, round(pm * lc / c, 6) AS pm_lc, row_number() OVER (ORDER BY c DESC, token) AS rank FROM wfr")
def freq_rank(spark, sf_dir):
    freq = frequency.positional_rank(S.frequencies(S.surface(spark, sf_dir)))
    return freq.select("token", "count", F.round("pm", 6).alias("pm"), F.round("pm_lc", 6).alias("pm_lc"), "rank")


@query(
    with_(SURFACE)
    + """, f AS (SELECT token, sum(c) AS fc FROM bylang WHERE lang = 'en' GROUP BY token), g AS (SELECT token, fc * 1e6 / (SELECT sum(fc) FROM f) AS fic_pm FROM f)
SELECT w.token, round(pm, 6) AS pm, round(fic_pm, 6) AS fic_pm, round((fic_pm + 1) / (pm + 1), 6) AS weirdness FROM wfr w JOIN g ON w.token = g.token"""
)
def fiction_weirdness(spark, sf_dir):
    by = S.surface(spark, sf_dir)
    special = by.filter("lang = 'en'").groupBy("token").agg(F.sum("count").alias("count"), F.sum("count_lc").alias("count_lc"))
    out = frequency.weirdness(S.frequencies(by), frequency.per_million(special))
    return out.select("token", *[F.round(c, 6).alias(c) for c in ("pm", "fic_pm", "weirdness")])


_POINTS = "[" + ", ".join(str(v) for v in T.TILE_POINTS.values()) + "]"


@query(
    with_(SURFACE)
    + f"""SELECT token AS word, length(token)::BIGINT AS char_len, length(regexp_replace(token, '[^\\p{{L}}]', '', 'g'))::BIGINT AS length, 1::BIGINT AS n_tokens, false AS is_phrase, regexp_matches(token, '^[a-z]+$') AS alpha_only,
CASE WHEN regexp_matches(token, '^[a-z]+$') THEN list_sum(list_transform(string_split(token, ''), lambda x: {_POINTS}[ascii(x) - 96]))::BIGINT END AS scrabble,
list_aggregate(list_sort(list_distinct(regexp_extract_all(token, '[jkqxz]'))), 'string_agg', '') AS rare_letters FROM frq"""
)
def word_shape(spark, sf_dir):
    return S.frequencies(S.surface(spark, sf_dir)).select(F.col("token").alias("word")).withColumns(T.word_shape(F.col("word")))


@query(with_(WORDS) + "SELECT word, c AS count, round(cap, 9) AS cap_ratio, round(pm_lc, 6) AS pm_lc, ety AS etymology_lang, wikt AS in_wiktionary, off AS is_offensive FROM wrd")
def dictionary_words(spark, sf_dir):
    words = S.dictionary(spark, sf_dir)
    return words.select("word", "count", F.round("cap_ratio", 9).alias("cap_ratio"), F.round("pm_lc", 6).alias("pm_lc"), "etymology_lang", "in_wiktionary", "is_offensive")


@query(with_(WORDS) + "SELECT count(*) AS n_words, sum(alpha::INT)::BIGINT AS n_alpha, sum(wikt::INT)::BIGINT AS n_wiktionary, sum(off::INT)::BIGINT AS n_offensive, count(rare) AS n_rare, count(DISTINCT ety) AS n_langs FROM wrd")
def dictionary_stats(spark, sf_dir):
    w = S.dictionary(spark, sf_dir)
    flag = lambda c: F.sum(F.col(c).cast("long"))
    return w.agg(F.count("*").alias("n_words"), flag("alpha_only").alias("n_alpha"), flag("in_wiktionary").alias("n_wiktionary"), flag("is_offensive").alias("n_offensive"), F.count("rare_letters").alias("n_rare"), F.countDistinct("etymology_lang").alias("n_langs"))


def _lemma_query(level):
    def run(spark, sf_dir):
        rooted, _ = S.lemmas(S.words_table(spark, sf_dir), level)
        return rooted.filter("word <> root")

    run.__name__ = f"lemma_level{level}"
    return query(with_(WORDS, lemma_sql(level)) + f"SELECT word, root FROM roo{level} WHERE word <> root")(run)


lemma_level1, lemma_level2 = _lemma_query(1), _lemma_query(2)


@query()
def lemma_level3(spark, sf_dir):
    words = S.words_table(spark, sf_dir)
    rooted, _ = S.lemmas(words, 3, S.word_vectors(spark, sf_dir, words), S.derivations(words))
    return rooted.filter("word <> root")


@query(with_(WORDS, lemma_sql(2)) + "SELECT root, round(pm, 6) AS pm, round(pm_lc, 6) AS pm_lc, n AS n_members FROM fam2")
def family_freq(spark, sf_dir):
    _, family = S.lemmas(S.words_table(spark, sf_dir), 2)
    return family.select("root", F.round("pm", 6).alias("pm"), F.round("pm_lc", 6).alias("pm_lc"), "n_members")


def level_candidates(spark, sf_dir, *levels, max_pm=scoring.MAX_PM):
    """The candidates of all books at some levels; the dictionary and the books' counts are made once for all."""
    words, counts = S.words_and_counts(spark, sf_dir)
    out = None
    for level in levels:
        more = (S.word_vectors(spark, sf_dir, words), S.derivations(words)) if level == 3 else ()
        rooted, family = S.lemmas(words, level, *more) if level else (None, None)
        own = scoring.candidates(counts, words, rooted, family, level, max_pm)
        out = own if out is None else out.unionByName(own)
    return out


@query(with_(TOKENS, WORDS, candidates_sql(0)) + "SELECT * FROM can0 WHERE rank <= 30")
def interesting_candidates(spark, sf_dir):
    return level_candidates(spark, sf_dir, 0).filter("rank <= 30")


def flagship(spark, sf_dir, max_pm=1000.0):
    """interesting_candidates with a bound on frequency that suits a corpus of some ten thousand words."""
    return scoring.candidates(S.book_counts(spark, sf_dir), S.dictionary(spark, sf_dir), max_pm=max_pm).filter("rank <= 30")


_LEVELS = (TOKENS, WORDS, lemma_sql(1), lemma_sql(2), candidates_sql(0), candidates_sql(1), candidates_sql(2))
_UNION = "SELECT * FROM can0 UNION ALL SELECT * FROM can1 UNION ALL SELECT * FROM can2"


@query(with_(*_LEVELS) + _UNION)
def candidates_levels_0_to_2(spark, sf_dir):
    """The levels that SQL can express; candidates_all_levels has level 3 too."""
    return level_candidates(spark, sf_dir, 0, 1, 2)


@query()
def candidates_all_levels(spark, sf_dir):
    return level_candidates(spark, sf_dir, 0, 1, 2, 3)


def rolled_up(kept):
    """book, level, n: candidates of each book and level, of each book, and of all (0 if there are none)."""
    by = kept.groupBy("book", "level").agg(F.count("*").alias("n"))
    books = by.groupBy("book").agg(F.lit(None).cast("int").alias("level"), F.sum("n").alias("n"))
    whole = by.agg(F.lit(None).cast("string").alias("book"), F.lit(None).cast("int").alias("level"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return by.unionByName(books).unionByName(whole)


@query(with_(*_LEVELS) + f"SELECT book, level, count(*) AS n FROM ({_UNION}) GROUP BY ROLLUP (book, level)")
def rollup_levels_0_to_2(spark, sf_dir):
    return rolled_up(candidates_levels_0_to_2(spark, sf_dir))


@query()
def rollup_candidates(spark, sf_dir):
    """The totals of all four levels."""
    return rolled_up(candidates_all_levels(spark, sf_dir))


WHY = """why AS (SELECT c.book, c.token, c.n, w.pm_lc AS pm, CASE WHEN w.word IS NULL THEN 'nodict' WHEN NOT alpha THEN 'nonalpha' WHEN k.word IS NOT NULL THEN '' WHEN NOT wikt THEN 'nowikt' WHEN off THEN 'offensive'
  WHEN cap > 0.5 THEN 'capitalised' WHEN len < 3 THEN 'short' WHEN w.pm_lc > 12.0 THEN 'common' ELSE '' END AS why FROM cnt c LEFT JOIN wrd w ON c.token = w.word LEFT JOIN can0 k ON k.book = c.book AND k.word = c.token)"""


def _reasons(spark, sf_dir):
    words, counts = S.words_and_counts(spark, sf_dir)
    return scoring.exclusion_reasons(counts, words, scoring.candidates(counts, words))


@query(with_(TOKENS, WORDS, candidates_sql(0), WHY) + "SELECT book, why, count(*) AS n_types, sum(n)::BIGINT AS n_tokens FROM why GROUP BY ALL")
def exclusion_report(spark, sf_dir):
    return scoring.reason_counts(_reasons(spark, sf_dir))


@query(with_(TOKENS, WORDS, candidates_sql(0), WHY) + "SELECT book, token, n AS count, round(pm, 6) AS pm, why FROM why WHERE why <> '' QUALIFY row_number() OVER (PARTITION BY book ORDER BY CASE WHEN coalesce(why.pm, 0) <= 0 THEN 1 ELSE 0 END, round(why.pm, 9) NULLS LAST, n DESC, token) <= 200")
def excluded_words(spark, sf_dir):
    return scoring.excluded_words(_reasons(spark, sf_dir)).withColumn("pm", F.round("pm", 6))


@query(
    with_(WORDS)
    + f"""SELECT CASE WHEN ety IN ({_common(scoring.FILTER_COMMON)}) THEN 'common' WHEN ety IN ({_common(scoring.FILTER_ROMANCE)}) THEN 'uncommon' ELSE 'rare' END AS tier, count(*) AS n FROM wrd WHERE ety IS NOT NULL GROUP BY 1"""
)
def origin_tiers(spark, sf_dir):
    o = F.col("etymology_lang")
    tier = F.when(scoring.uncommon_origin(o, True), "rare").when(scoring.uncommon_origin(o), "uncommon").otherwise("common")
    return S.dictionary(spark, sf_dir).filter(o.isNotNull()).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query(
    with_(TOKENS, WORDS, candidates_sql(0))
    + """, ps AS (SELECT word, CASE WHEN ends_with(word, 'ing') OR ends_with(word, 'ed') THEN 'verb' WHEN ends_with(word, 'ly') THEN 'adv' WHEN regexp_matches(word, '(able|ible|ish|al|ous)$') THEN 'adj' WHEN length(word) <= 2 THEN 'prep' ELSE 'noun' END AS pos FROM wrd
  UNION SELECT word, 'noun' FROM wrd WHERE rare IS NOT NULL)
SELECT pos AS category, count(DISTINCT c.word) AS n FROM can0 c JOIN ps ON c.word = ps.word GROUP BY 1"""
)
def category_counts(spark, sf_dir):
    words, counts = S.words_and_counts(spark, sf_dir)
    kept = scoring.candidates(counts, words).select("word").distinct()
    return S.word_pos(words).join(kept, "word", "left_semi").groupBy(F.col("pos").alias("category")).agg(F.countDistinct("word").alias("n"))


# Parts of speech in order of preference, and the headings of those that sections go through.
POS_ORDER = ("noun", "verb", "adj", "adv", "intj", "prep", "pron", "conj", "num", "det", "particle", "contraction")
POS_HEADINGS = {"noun": "nouns", "verb": "verbs", "adj": "adjectives", "adv": "adverbs"}


def primary_pos(pos):
    """word, pos: the curated source's opinion first, then the earliest class of POS_ORDER."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, POS_ORDER)), F.col("pos")), F.lit(0))
    rank = F.when(rank == 0, len(POS_ORDER)).otherwise(rank)
    return pos.groupBy("word").agg(F.min_by("pos", F.struct((F.col("source") != "wordnet").alias("s"), rank.alias("r"))).alias("pos"))


def pos_arranged(items, key: str, order: str, chunk: int = 20):
    """items (key, pos, order) with section, section_no and place: `chunk` of each content class in turn, then others."""
    cls = F.when(F.col("pos").isin(*POS_HEADINGS), F.col("pos"))
    own = W.partitionBy(key, "_c").orderBy(order)
    rn = F.row_number().over(own)
    numbered = items.withColumn("_c", cls).withColumn("_n", rn).withColumn("_others", F.count(F.when(F.col("_c").isNull(), 1)).over(W.partitionBy(key)))
    turn = F.when(F.col("_c").isNull(), 1 << 30).otherwise(F.floor((F.col("_n") - 1) / chunk))
    which = F.coalesce(F.array_position(F.array(*map(F.lit, POS_HEADINGS)), F.col("_c")), F.lit(9)).cast("int")
    heading = F.coalesce(F.create_map(*[F.lit(x) for p in POS_HEADINGS.items() for x in p])[F.col("_c")], F.concat(F.lit("other ("), F.col("_others"), F.lit(")")))
    seq = W.partitionBy(key).orderBy("_turn", "_which", "_n")
    out = numbered.withColumns({"_turn": turn, "_which": which, "section": heading})
    return out.withColumn("place", F.row_number().over(seq).cast("long")).withColumn("section_no", F.dense_rank().over(W.partitionBy(key).orderBy("_turn", "_which")).cast("long")).drop("_c", "_n", "_others", "_turn", "_which")


@query(
    with_(TOKENS, WORDS, candidates_sql(0))
    + f""", ps AS (SELECT word, CASE WHEN rare IS NOT NULL THEN 'noun' WHEN ends_with(word, 'ing') OR ends_with(word, 'ed') THEN 'verb' WHEN ends_with(word, 'ly') THEN 'adv' WHEN regexp_matches(word, '(able|ible|ish|al|ous)$') THEN 'adj' WHEN length(word) <= 2 THEN 'prep' ELSE 'noun' END AS pos FROM wrd),
j AS (SELECT c.book, c.word, c.rank, ps.pos FROM can0 c JOIN ps ON c.word = ps.word WHERE c.rank <= {PAGE}),
n AS (SELECT *, row_number() OVER (PARTITION BY book, CASE WHEN pos IN ('noun', 'verb', 'adj', 'adv') THEN pos END ORDER BY rank) AS rn, count(*) FILTER (pos NOT IN ('noun', 'verb', 'adj', 'adv')) OVER (PARTITION BY book) AS o FROM j),
s AS (SELECT *, CASE WHEN pos IN ('noun', 'verb', 'adj', 'adv') THEN (rn - 1) // 20 ELSE 1073741824 END AS turn, CASE pos WHEN 'noun' THEN 1 WHEN 'verb' THEN 2 WHEN 'adj' THEN 3 WHEN 'adv' THEN 4 ELSE 9 END AS wh,
  CASE pos WHEN 'noun' THEN 'nouns' WHEN 'verb' THEN 'verbs' WHEN 'adj' THEN 'adjectives' WHEN 'adv' THEN 'adverbs' ELSE 'other (' || o || ')' END AS section FROM n)
SELECT book, word, section, dense_rank() OVER (PARTITION BY book ORDER BY turn, wh) AS section_no, row_number() OVER (PARTITION BY book ORDER BY turn, wh, rn) AS place FROM s"""
)
def pos_sections(spark, sf_dir, most=PAGE):
    words, counts = S.words_and_counts(spark, sf_dir)
    kept = scoring.candidates(counts, words).filter(F.col("rank") <= most).select("book", "word", "rank")
    return pos_arranged(kept.join(primary_pos(S.word_pos(words)), "word"), "book", "rank").select("book", "word", "section", "section_no", "place")


@query(
    with_(TOKENS, WORDS, candidates_sql(0))
    + """, top AS (SELECT word FROM can0 WHERE book = 'src1' AND rank <= 100), o AS (SELECT c.token AS word, c.book, c.n, row_number() OVER (PARTITION BY c.token ORDER BY c.n DESC, c.book) AS k FROM cnt c JOIN top ON c.token = top.word WHERE c.book <> 'src1')
SELECT word, book, n AS count FROM o WHERE k <= 20"""
)
def also_in(spark, sf_dir, book="src1"):
    """Where else the first candidates of a book occur."""
    words, counts = S.words_and_counts(spark, sf_dir)
    top = scoring.candidates(counts, words).filter((F.col("book") == book) & (F.col("rank") <= 100)).select(F.col("word").alias("token"))
    other = counts.filter(F.col("book") != book).join(top, "token", "left_semi")
    rank = F.row_number().over(W.partitionBy("token").orderBy(F.col("count").desc(), "book"))
    return other.withColumn("k", rank).filter("k <= 20").select(F.col("token").alias("word"), "book", "count")


@query(
    with_(TOKENS, WORDS, lemma_sql(2))
    + """SELECT root, word, round(pm, 6) AS pm, k AS place FROM (SELECT r.root, w.word, w.pm, row_number() OVER (PARTITION BY r.root ORDER BY w.pm DESC NULLS LAST, w.word) AS k FROM roo2 r JOIN wrd w ON r.word = w.word JOIN fam2 f ON f.root = r.root) WHERE k <= 15"""
)
def top_family(spark, sf_dir):
    words = S.words_table(spark, sf_dir)
    rooted, family = S.lemmas(words, 2)
    members = rooted.join(family.select("root"), "root", "left_semi").join(words.select("word", "pm"), "word")
    place = F.row_number().over(W.partitionBy("root").orderBy(F.col("pm").desc_nulls_last(), "word")).cast("long")
    return members.withColumn("place", place).filter("place <= 15").select("root", "word", F.round("pm", 6).alias("pm"), "place")


@query(
    with_(TOKENS, WORDS, lemma_sql(2), candidates_sql(2))
    + f""", m AS (SELECT c.book, coalesce(r.root, c.token) AS word, string_agg(c.token, '/' ORDER BY c.n DESC, c.token) AS forms, count(*) AS k FROM cnt c JOIN wrd w ON c.token = w.word AND w.alpha LEFT JOIN roo2 r ON r.word = c.token GROUP BY ALL)
SELECT c.book, string_agg(CASE WHEN k > 1 THEN c.word || ' ' || forms ELSE c.word END, chr(10) ORDER BY rank) AS list FROM can2 c JOIN m ON c.book = m.book AND c.word = m.word WHERE rank <= {PAGE} GROUP BY c.book"""
)
def plain_list_export(spark, sf_dir, most=PAGE):
    words, counts = S.words_and_counts(spark, sf_dir)
    rooted, family = S.lemmas(words, 2)
    top = scoring.candidates(counts, words, rooted, family, 2).filter(F.col("rank") <= most).select("book", "word", "rank")
    known = counts.join(rooted.select(F.col("word").alias("token"), F.col("root").alias("word")), "token")
    forms = known.join(top, ["book", "word"]).groupBy("book", "word", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "token"))).alias("f"))  # forms of one word
    line = F.when(F.size("f") > 1, F.concat(F.col("word"), F.lit(" "), F.array_join("f.token", "/"))).otherwise(F.col("word"))
    lines = forms.select("book", "rank", line.alias("line"))
    return lines.groupBy("book").agg(F.array_join(F.sort_array(F.collect_list(F.struct("rank", "line")))["line"], "\n").alias("list"))


@query(with_(TOKENS) + "SELECT DISTINCT token FROM tok WHERE book = 'src1' UNION SELECT DISTINCT token FROM tok WHERE book = 'src2'")
def union_words(spark, sf_dir, one="src1", two="src2"):
    """The words of two books."""
    return S.book_counts(spark, sf_dir).filter(F.col("book").isin(one, two)).select("token").distinct()


@query(with_(TOKENS) + "SELECT token, n AS count, token IN (SELECT token FROM cnt WHERE book = 'src2') AS shared FROM cnt WHERE book = 'src1'")
def semi_anti_join(spark, sf_dir, one="src1", two="src2"):
    """The words of one book, those shared with another marked."""
    counts = S.counts_table(spark, sf_dir)
    own, other = counts.filter(F.col("book") == one).select("token", "count"), counts.filter(F.col("book") == two).select("token")
    return own.join(other, "token", "left_semi").withColumn("shared", F.lit(True)).unionByName(own.join(other, "token", "left_anti").withColumn("shared", F.lit(False)))
