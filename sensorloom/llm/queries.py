"""The registered queries of the text operators, each over its whole tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.llm import chunk_dedup, decontaminate, fill_middle, html_text, importance, line_dedup, mixing, quality, quality_rank, simhash, suffix_dedup, toxicity, url_filter
from sensorloom.llm.common import BLANKS, UPPER, identified, table, without_spans

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


_SQL_BLANKS = "||".join(f"chr({ord(c)})" for c in BLANKS)
_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

LINES = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_LOWER} AS low FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(string_split(low, chr(10))) AS k,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
k AS (SELECT doc_id, line, pos, trim(k, {_SQL_BLANKS}) AS k FROM l),
c AS (SELECT k FROM k WHERE length(k) > 0 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.k IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.k = c.k GROUP BY doc_id
"""


@query("op1_line_dedup", LINES)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    applied = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_documents=10, drop=line_dedup.DROP_ALL))
    return applied.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_simhash")
def op2(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, bits=3)


@query("op3_html_text")
def op3(spark, sf_dir):
    pages = html_text.extracted(table(spark, sf_dir, "pages"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT doc_id, hex(b) AS x, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS p FROM x WHERE n >= 100)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER o + 100 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, island),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT * FROM s UNION ALL SELECT doc_id, -1, 0 FROM x)),
t AS (SELECT k.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS kept FROM k JOIN x USING (doc_id) GROUP BY k.doc_id),
c AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM s GROUP BY doc_id)
SELECT x.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM x JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@query("op5_suffix_dedup", REPEATS)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = without_spans(identified(docs), suffix_dedup.repeated_spans(docs))
    return kept.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_chunk_dedup")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = without_spans(identified(docs), chunk_dedup.repeated_chunks(docs, min_run=0))
    return kept.select(F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _verdict(rules) -> str:
    """The rule table as a condition in SQL."""
    parts = [f"{r.measure} < {r.lowest}" for r in rules if r.lowest is not None]
    parts += [f"{r.measure} > {r.highest}" for r in rules if r.highest is not None]
    return " OR ".join(parts)


_STOP = ", ".join(f"'{w}', '{w.capitalize()}'" for w in quality.STOP_WORDS)
QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: trim(x, {_SQL_BLANKS}) <> '') AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM g),
r AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS c FROM n WHERE n > 1),
s AS (SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
    len(list_filter(w, lambda x: list_contains([{_STOP}], x))) AS n_stop, len(string_split(t, chr(10))) AS n_lines
    FROM w LEFT JOIN s USING (doc_id)),
q AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_length,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_ratio,
    n_dup_lines / n_lines AS dup_line_ratio,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({_verdict(quality.RULES)}) AS kept FROM q
"""


@query("op7_quality", QUALITY)
def op7(spark, sf_dir):
    measures = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(table(spark, sf_dir, "documents")).select(*measures)


TOPICS = 8
ROUNDS = 12
MARGINS = mixing.Mix(
    (
        mixing.Margin("source", (("src0", 0.25),), rest=0.75),
        mixing.Margin("lang", (("en", 0.55), ("de", 0.17), ("fr", 0.17), ("es", 0.11)), rest=0.02),
        mixing.Margin("topic", tuple((str(k), 1 / TOPICS) for k in range(TOPICS))),
    ),
    budget=0.15,
)


def with_margins(docs, id_col: str = "doc_id"):
    return docs.select(
        id_col, "source", "lang", mixing.lead_topic(F.col("text"), TOPICS).alias("topic"), mixing.word_count(F.col("text")).alias("tokens")
    )


def _raking(margins, rounds) -> str:
    """The raked shares as common table expressions, one for each step."""
    steps, last = [], "r0"
    for number in range(rounds * len(margins)):
        margin = margins[number % len(margins)]
        goals = ", ".join(f"('{n}', {s!r}::DOUBLE)" for n, s in margin.target().items())
        steps.append(
            f"""r{number + 1} AS MATERIALIZED (SELECT source, lang, topic,
    v * goal / (SELECT sum(goal) FROM (VALUES {goals}) g(name, goal) WHERE name IN (SELECT {margin.name} FROM {last}))
    / sum(v) OVER (PARTITION BY {margin.name}) AS v
    FROM {last} JOIN (VALUES {goals}) g(name, goal) ON name = {margin.name})"""
        )
        last = f"r{number + 1}"
    return ",\n".join(steps)


_CLASSES = ", ".join(
    f"CASE WHEN {m.name} IN ({', '.join(repr(n) for n, _ in m.shares)}) THEN {m.name} ELSE '{mixing.OTHER}' END AS {m.name}" for m in MARGINS
)
MIXED = rf"""
WITH d AS (SELECT doc_id, source, lang,
    ((('0x' || substr(md5(regexp_extract(coalesce(text, ''), '[a-z]{{5,}}')), 1, 8))::BIGINT) % {TOPICS})::VARCHAR AS topic,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS tokens FROM documents),
c AS (SELECT doc_id, tokens, {_CLASSES} FROM d),
o AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS n FROM c GROUP BY ALL),
r0 AS MATERIALIZED (SELECT source, lang, topic, n / (SELECT sum(n) FROM o) AS v FROM o WHERE n > 0),
{_raking(MARGINS, ROUNDS)},
w AS (SELECT o.source, o.lang, o.topic, v / (n / (SELECT sum(n) FROM o)) AS w
    FROM o LEFT JOIN r{ROUNDS * len(MARGINS)} r ON o.source = r.source AND o.lang = r.lang AND o.topic = r.topic)
SELECT doc_id, c.source, c.lang, c.topic, tokens, round(w, 6) AS weight,
    round(coalesce(w / (SELECT max(w) FROM w), 1), 6) AS probability,
    (('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0 < coalesce(w / (SELECT max(w) FROM w), 1) AS sampled
FROM c JOIN w ON c.source = w.source AND c.lang = w.lang AND c.topic = w.topic
"""


@query("op8_mixing", MIXED)
def op8(spark, sf_dir):
    # the SQL has no budget: its largest weight has probability 1
    drawn = mixing.mixed(with_margins(table(spark, sf_dir, "documents")), tuple(MARGINS), rounds=ROUNDS)
    return drawn.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


FIRST_DAY = "2024-01-01"
URLS = rf"""
WITH c AS (SELECT page_id, url, (DATE '{FIRST_DAY}' + (page_id % 366)::INTEGER)::DATE AS fetched,
    coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)), '') AS host FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS n FROM c WHERE host <> ''),
e AS (SELECT host AS key, DATE '{FIRST_DAY}' + (n % 300)::INTEGER AS day, 'block' AS action FROM h WHERE n % 2 = 0
    UNION ALL SELECT host, DATE '{FIRST_DAY}' + (n % 300)::INTEGER, 'allow' FROM h WHERE n % 10 = 0
    UNION ALL SELECT host, DATE '{FIRST_DAY}' + (n % 300 + 30 + n % 45)::INTEGER, 'allow' FROM h WHERE n % 6 = 0
    UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), DATE '{FIRST_DAY}' + (n % 200)::INTEGER, 'block'
    FROM h WHERE n % 5 = 0),
d AS (SELECT key, day, max(action) AS action FROM e WHERE key <> '' GROUP BY key, day),
v AS (SELECT key, action, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM d),
s AS (SELECT page_id, url, fetched, host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1),
    lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key FROM c),
f AS (SELECT s.*, v.key AS entry, v.action, v.since, row_number() OVER (PARTITION BY page_id ORDER BY length(v.key) DESC NULLS LAST) AS place
    FROM s LEFT JOIN v ON s.key = v.key AND fetched >= since AND (until IS NULL OR fetched < until))
SELECT page_id, url, fetched, host, entry, action, since::DATE AS since, coalesce(action = 'block', false) AS blocked FROM f WHERE place = 1
"""


def dated_list(pages):
    """A dated list of hosts and domains made from the pages' own hosts."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    n = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    day = lambda offset: F.date_add(F.lit(FIRST_DAY).cast("date"), offset.cast("int"))
    entry = lambda key, offset, action: F.struct(key.alias("key"), day(offset).alias("day"), F.lit(action).alias("action"))
    host = F.col("host")
    made = F.array(
        F.when(n % 2 == 0, entry(host, n % 300, url_filter.BLOCK)),
        F.when(n % 10 == 0, entry(host, n % 300, url_filter.ALLOW)),
        F.when(n % 6 == 0, entry(host, n % 300 + 30 + n % 45, url_filter.ALLOW)),
        F.when(n % 5 == 0, entry(F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1), n % 200, url_filter.BLOCK)),
    )
    return hosts.select(F.explode(F.array_compact(made)).alias("e")).select("e.*")


@query("op9_url_filter", URLS)
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") % 366).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    return url_filter.evaluate(captures, dated_list(pages))


_NOT_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_NOT_WORD}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '{_NOT_WORD}') AS w FROM benchmark),
k AS (SELECT item, least(10, len(w)) AS n, w FROM b WHERE len(w) > 0),
i AS (SELECT DISTINCT item, n, list_slice(w, o, o + n - 1) AS g FROM (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS o FROM k)),
p AS (SELECT doc_id, n, list_slice(w, o, o + n - 1) AS g, o
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS o FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
f AS (SELECT doc_id, o, n, item FROM p JOIN i USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + n)) AS q FROM f) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op10_decontaminate", CONTAMINATION)
def op10(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


MIDDLES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, list_transform(range(4),
    lambda k: ('0x' || substr(x, 8 * k::INTEGER + 1, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, len(w) AS n, h[1] % (len(w) + 1) AS p, h[2] % (len(w) + 1) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
k AS (SELECT doc_id, t, n, form, array_to_string(list_slice(w, 1, least(p, q)), '') AS a,
    array_to_string(list_slice(w, least(p, q) + 1, greatest(p, q)), '') AS b, array_to_string(list_slice(w, greatest(p, q) + 1, n), '') AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END)
    AS output_sha256, sha256(t) AS restored_sha256 FROM k
"""


@query("op12_fill_middle", MIDDLES)
def op12(spark, sf_dir):
    done = fill_middle.fill_middle(table(spark, sf_dir, "documents"), seed=1)
    rebuilt = fill_middle.restored(F.col("output"), F.col("form"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"),
    )


# A checksum is linear in the bytes: z holds what each byte value at each distance from the end adds, and (byte 256) the start value after so many bytes
IMPORTANCE = rf"""
WITH RECURSIVE bits AS (SELECT b::UBIGINT AS b, b::UBIGINT AS c, 0 AS k FROM range(256) r(b)
    UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all({_LOWER}, '{_NOT_WORD}') AS w FROM documents
    UNION ALL SELECT 't', item_id, regexp_extract_all({_LOWER}, '{_NOT_WORD}') FROM benchmark),
g AS MATERIALIZED (SELECT side, id, array_to_string(list_slice(w, o, o + n - 1), ' ') AS g
    FROM (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS o FROM w, range(1, 4) r(n) WHERE len(w) >= n)),
u AS MATERIALIZED (SELECT g, octet_length(encode(g)) AS n, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM g)),
z AS (SELECT 0 AS k, b, c FROM t UNION ALL SELECT 0, 256::UBIGINT, 4294967295::UBIGINT
    UNION ALL SELECT k + 1, z.b, xor(t.c, z.c >> 8) FROM z JOIN t ON t.b = z.c & 255 WHERE k < (SELECT max(n) FROM u)),
zm AS MATERIALIZED (SELECT * FROM z),
y AS (SELECT g, n, ('0x' || substr(x, 2 * p + 1, 2))::UBIGINT AS b, n - 1 - p AS k FROM (SELECT g, n, x, unnest(range(n)) AS p FROM u)),
v AS (SELECT g, any_value(n) AS n, bit_xor(c) AS c FROM y JOIN zm USING (k, b) GROUP BY g),
h AS MATERIALIZED (SELECT g, (xor(xor(v.c, zm.c), 4294967295::UBIGINT) % {importance.BUCKETS})::BIGINT AS bucket FROM v JOIN zm ON zm.b = 256 AND zm.k = v.n),
f AS MATERIALIZED (SELECT side, id, bucket, count(*) AS n FROM g JOIN h USING (g) GROUP BY ALL),
a AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM f GROUP BY bucket),
m AS (SELECT sum(s) AS s, sum(t) AS t FROM a),
e AS (SELECT bucket, floor(1000 * ln(((a.t + 1) * (m.s + {importance.BUCKETS})) / ((a.s + 1) * (m.t + {importance.BUCKETS}))))::BIGINT AS gain FROM a, m),
q AS (SELECT id AS doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN e USING (bucket) WHERE side = 'd' GROUP BY id),
k AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
    FROM w LEFT JOIN q ON w.id = q.doc_id WHERE side = 'd'),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM k WHERE n_words >= {importance.MIN_WORDS})
SELECT doc_id, n_features, weight, score,
    CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM k WHERE n_words >= {importance.MIN_WORDS}) THEN rank END AS rank
FROM k LEFT JOIN r USING (doc_id)
"""


@query("op13_importance", IMPORTANCE)
def op13(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


@query("op11_quality_rank")
def op11(spark, sf_dir):
    rows = quality_rank.described(table(spark, sf_dir, "documents"))
    scored = quality_rank.score(rows, quality_rank.fit(rows, table(spark, sf_dir, "labels"), learn=~held_out()))
    return scored.select(
        F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), "score", (F.col("score") >= quality_rank.CUT).cast("int").alias("predicted")
    )
