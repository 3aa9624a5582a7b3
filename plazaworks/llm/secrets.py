"""Secrets in texts: fixed patterns, and strings that look drawn at random.

Two Markov models of characters, one of random strings and one of ordinary
words and identifiers, are trained from labelled samples. What a string of
letters, digits and signs is, the logarithm of the ratio of its two likelihoods
says: the sum of one weight for each pair of neighbouring characters. Training
and search are column expressions; texts are neither shuffled nor sent to
Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plazaworks.llm.shared import fresh

#: Characters that the models know, and a string of them that is judged. Codes run from the first of them to the last.
SIGNS = r"A-Za-z0-9+/_=-"
FIRST, CODES, KNOWN = ord("+"), ord("z") - ord("+") + 1, 67
LEAST_CHARS = 16
CANDIDATE = f"[{SIGNS}]{{{LEAST_CHARS},}}"

_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs of hexadecimal digits, and of capitals and digits from AKIA on, are maximal: their least length can be part of the pattern.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_VALUE = 6
#: Kinds in the order of spans that start together.
KINDS = ("assign", "access", "hex", "random")

#: Training: documents whose words are ordinary (a bounded sample, those of the smallest MD5 of the id), random strings of each make,
#: and the logarithm (in thousandths) by which a string must be likelier as a random one: random ones are rare.
SAMPLE_DOCS, SAMPLE_STRINGS, MARGIN = 5000, 4096, 12_000
LEAST_WORD = 4


@dataclass(frozen=True)
class Model:
    """A weight for each pair of characters, in thousandths: how much likelier the second follows the first in a random string."""

    weights: tuple[int, ...]

    def column(self) -> Column:
        """The weights as one literal array, by code of the first character times CODES plus that of the second."""
        return F.from_json(F.lit(str(list(self.weights))), "array<int>")


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c) - FIRST)


def train(samples: DataFrame) -> Model:
    """The weights that samples (text, random) give, each pair counted once more than it occurs.

    random is true for random strings, false for ordinary ones; other rows,
    null texts and characters that the models don't know count for nothing.
    At most two numbers for each pair of characters come to the driver.
    """
    known = samples.filter("random IS NOT NULL").select("random", _codes(F.regexp_replace("text", f"[^{SIGNS}]", " ")).alias("codes"))
    pairs = F.zip_with("codes", F.slice("codes", 2, 1 << 30), lambda a, b: F.when((a >= 0) & (b >= 0), a * CODES + b))
    counts = known.select("random", F.explode(pairs).alias("pair")).filter("pair IS NOT NULL").groupBy("random", "pair").count().collect()
    of: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in counts:
        of[r["random"]][r["pair"]] = r["count"]
    after = {label: [sum(n for p, n in pairs.items() if p // CODES == a) for a in range(CODES)] for label, pairs in of.items()}
    chance = lambda label, a, b: math.log((of[label].get(a * CODES + b, 0) + 1) / (after[label][a] + KNOWN))
    return Model(tuple(math.floor(1000 * (chance(True, a, b) - chance(False, a, b)) + 0.5) for a in range(CODES) for b in range(CODES)))


def random_strings(spark: SparkSession, each: int = SAMPLE_STRINGS) -> DataFrame:
    """(text, random): strings of four alphabets, made of digests of numbers: base 64, hexadecimal digits, capitals or small letters and digits."""
    drawn = lambda tag: F.base64(F.unhex(F.sha2(F.concat(F.lit(tag), F.col("id").cast("string")), 256)))
    mixed = lambda tag: F.regexp_replace(drawn(tag), "[+/=]", "")
    texts = F.array(F.rtrim(drawn("a"), F.lit("=")), F.left(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256), F.lit(40)), F.upper(mixed("c")), F.lower(mixed("d")))
    return spark.range(each).select(F.explode(texts).alias("text"), F.lit(True).alias("random"))


def ordinary_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """(text, random): words of the documents (most of them at most) whose ids' MD5 are the smallest, without what the fixed patterns match."""
    key = F.md5(F.col(f"`{id_col}`").cast("string"))
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), key.alias("key")).filter("key IS NOT NULL").distinct().orderBy("key").limit(most)
    whole = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    text = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    words = F.regexp_extract_all(text, F.lit(f"[{SIGNS}]{{{LEAST_WORD},}}"), F.lit(0))
    return whole.join(chosen.select("id"), "id", "left_semi").select(F.explode(words).alias("text"), F.lit(False).alias("random"))


def model_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    return train(ordinary_words(docs, id_col, text_col).unionByName(random_strings(docs.sparkSession)))


def likelihood_ratio(text: Column, model: Model) -> Column:
    """The logarithm, in thousandths, of how much likelier the text is as a random string; its characters must be known ones."""
    weights = model.column()
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))
    add = lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0).otherwise(F.get(weights, s["last"] * CODES + c))).alias("sum"))
    return F.aggregate(_codes(text), start, add, lambda s: s["sum"])


def _running(df: DataFrame, keep: list[Column], names: list[str], sums: list[str]) -> DataFrame:
    """df with the running totals of arrays of numbers in place of them; work of n * sqrt(n) for n numbers.

    Totals of blocks of about sqrt(n) numbers first, then those before each
    block, then within it; each step reads what the last one left in a column.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    width = lambda c: F.greatest(F.lit(1), F.floor(F.sqrt(F.size(c))).cast("int"))
    df = df.select(*keep, *names, *[width(c).alias(s) for c, s in zip(names, sums, strict=True)])

    def blocks(c: str, s: str) -> Column:
        starts = F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1, F.col(s)))
        return F.struct(F.col(s).alias("width"), F.transform(starts, lambda k: total(F.slice(c, k + 1, F.col(s)))).alias("totals"))

    df = df.select(*keep, *names, *[blocks(c, s).alias(s) for c, s in zip(names, sums, strict=True)])
    before = lambda s: F.struct(F.col(s)["width"].alias("width"), F.transform(F.col(s)["totals"], lambda _, j: total(F.slice(F.col(s)["totals"], F.lit(1), j))).alias("before"))
    df = df.select(*keep, *names, *[before(s).alias(s) for s in sums])

    def within(c: str, s: str) -> Column:
        size = F.col(s)["width"]
        return F.transform(c, lambda _, i: F.get(F.col(s)["before"], (i / size).cast("int")) + total(F.slice(c, i - i % size + 1, i % size + 1)))

    return df.select(*keep, *names, *[within(c, s).alias(s) for c, s in zip(names, sums, strict=True)])


def with_secrets(df: DataFrame, model: Model, text: str = "text", name: str = "secrets") -> DataFrame:
    """df with a struct column: n_assign, n_access, n_hex (long), base and spans, arrays of (kind, start, end) by start, then kind as in KINDS.

    Places are code points of the whole text, end exclusive. base has what the
    fixed patterns match: of the leftmost matches of each that don't overlap,
    assignments whose value has LEAST_VALUE characters, access keys, and
    hexadecimal strings. spans has these and the random strings: the longest
    stretches of known characters, LEAST_CHARS at least, that the models find
    likelier to be random by more than MARGIN. A string may be reported by
    several kinds. A null or empty text has no spans. Each row is judged by
    itself: repeated rows and ids fare alike, an empty table gives an empty
    one, and other columns stay, whatever their names (the struct's name gets
    underscores until it is new).
    """
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True))
    made, t, w, m, *rest = fresh(df, name, "_text", "_whole", "_made", *[f"_{x}_{k}" for x in ("steps", "ends") for k in KINDS])
    steps, ends = rest[: len(KINDS)], rest[len(KINDS) :]
    keep = [F.col(f"`{c}`") for c in df.columns]
    read = df.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))

    # What is matched and how long what lies between is; most texts have no match, which one search tells.
    def cut(kind: str, pattern: str) -> Column:
        matched = [F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("whole"), F.transform(F.split(t, pattern, -1), F.length).alias("between")]
        value = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(2)), F.length) if kind == "assign" else F.lit(None).cast("array<int>")
        return F.when(F.rlike(t, F.lit(pattern)), F.struct(*matched, value.alias("value"))).alias(kind)

    read = read.select(*keep, F.struct(*[cut(k, p) for k, p in patterns.items()]).alias(w))
    none = F.array().cast("array<int>")
    step = lambda k: F.coalesce(F.zip_with(F.transform(F.col(w)[k]["whole"], F.length), F.slice(F.col(w)[k]["between"], F.lit(1), F.size(F.col(w)[k]["whole"])), lambda a, b: a + b), none)
    read = read.select(*keep, w, *[step(k).alias(s) for k, s in zip(KINDS, steps, strict=True)])
    read = _running(read, [*keep, F.col(w)], steps, ends)

    def spans(kind: str, end: str) -> Column:
        at = F.col(w)[kind]
        placed = F.zip_with(end, at["whole"], lambda e, x: F.struct((e - F.length(x)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), e.alias("end"), x.alias("text")))
        if kind == "assign":
            placed = F.filter(placed, lambda _, i: F.get(at["value"], i) >= LEAST_VALUE)
        if kind == "random":
            placed = F.filter(placed, lambda x: likelihood_ratio(x["text"], model) > MARGIN)
        bare = F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))
        return F.coalesce(bare, F.array().cast("array<struct<start: bigint, rank: int, end: bigint>>")).alias(kind)

    read = read.select(*keep, F.struct(*[spans(k, e) for k, e in zip(KINDS, ends, strict=True)]).alias(m))
    kinds = F.array(*map(F.lit, KINDS))
    listed = lambda *of: F.transform(F.array_sort(F.concat(*[F.col(m)[k] for k in of])), lambda x: F.struct(F.get(kinds, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    counts = [F.size(F.col(m)[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return read.select(*keep, F.struct(*counts, listed(*KINDS[:3]).alias("base"), listed(*KINDS).alias("spans")).alias(made))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _sql_matches(kind: str, pattern: str, value: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"SELECT uid, '{kind}' AS kind, {KINDS.index(kind)} AS rank, unnest(regexp_extract_all(text, '{quoted}')) AS whole, unnest({value.format(quoted)}) AS value, unnest(string_split_regex(text, '{quoted}')) AS between, generate_subscripts(string_split_regex(text, '{quoted}'), 1) AS i FROM d"


_SQL_ASSIGN = ASSIGN.replace("'", "''")
_SQL_PAIRS = f"(ascii(text[i]) - {FIRST}) * {CODES} + ascii(text[i + 1]) - {FIRST}"

#: The result of op12 in DuckDB's SQL, training included.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
chosen AS (SELECT DISTINCT doc_id, md5(doc_id::VARCHAR) AS key FROM documents WHERE doc_id IS NOT NULL ORDER BY key LIMIT {SAMPLE_DOCS}),
words AS (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '{_SQL_ASSIGN}', ' ', 'g'), '{ACCESS}', ' ', 'g'), '{HEX}', ' ', 'g'), '[{SIGNS}]{{{LEAST_WORD},}}')) AS text, false AS random FROM d WHERE doc_id IN (SELECT doc_id FROM chosen)),
drawn AS (SELECT id, to_base64(unhex(sha256('a' || id))) AS a, sha256('b' || id) AS b, to_base64(unhex(sha256('c' || id))) AS c, to_base64(unhex(sha256('d' || id))) AS d FROM range({SAMPLE_STRINGS}) r(id)),
samples AS (SELECT * FROM words UNION ALL SELECT unnest([rtrim(a, '='), left(b, 40), upper(regexp_replace(c, '[+/=]', '', 'g')), lower(regexp_replace(d, '[+/=]', '', 'g'))]), true FROM drawn),
pairs AS (SELECT random, {_SQL_PAIRS} AS pair FROM (SELECT random, text, unnest(range(1, length(text))) AS i FROM samples)),
counts AS (SELECT random, pair, count(*) AS n FROM pairs GROUP BY ALL),
whole AS (SELECT random, pair // {CODES} AS a, sum(n) AS n FROM counts GROUP BY ALL),
cells AS (SELECT c.random, p.pair, ln((coalesce(k.n, 0) + 1) / (coalesce(w.n, 0) + {KNOWN})::DOUBLE) AS l FROM range({CODES * CODES}) p(pair), (SELECT unnest([true, false]) AS random) c
  LEFT JOIN counts k ON k.random = c.random AND k.pair = p.pair LEFT JOIN whole w ON w.random = c.random AND w.a = p.pair // {CODES}),
weights AS (SELECT pair, floor(1000 * (max(l) FILTER (random) - max(l) FILTER (NOT random)) + 0.5)::BIGINT AS w FROM cells GROUP BY pair),
matched AS ({_sql_matches("assign", ASSIGN, "regexp_extract_all(text, '{}', 2)")} UNION ALL {_sql_matches("access", ACCESS, "regexp_extract_all(text, '{}')")}
  UNION ALL {_sql_matches("hex", HEX, "regexp_extract_all(text, '{}')")} UNION ALL {_sql_matches("random", CANDIDATE, "regexp_extract_all(text, '{}')")}),
placed AS (SELECT *, sum(length(between) + coalesce(length(whole), 0)) OVER (PARTITION BY uid, kind ORDER BY i) AS e FROM matched),
scored AS (SELECT uid, k, sum(w) AS score FROM (SELECT uid, k, {_SQL_PAIRS} AS pair FROM (SELECT uid, i AS k, whole AS text, unnest(range(1, length(whole))) AS i FROM matched WHERE kind = 'random' AND whole IS NOT NULL)) JOIN weights USING (pair) GROUP BY ALL),
spans AS (SELECT uid, kind, rank, (e - length(whole))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE whole IS NOT NULL AND kind <> 'random' AND (kind <> 'assign' OR length(value) >= {LEAST_VALUE})
  UNION ALL SELECT p.uid, p.kind, p.rank, (e - length(whole))::BIGINT, e::BIGINT FROM placed p JOIN scored q ON q.uid = p.uid AND q.k = p.i WHERE p.kind = 'random' AND q.score > {MARGIN}),
found AS (SELECT uid, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (uid)
"""
