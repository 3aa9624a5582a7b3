"""Queries of single functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazaworks.functions import geo, similarity, text, time
from plazaworks.operators import library
from plazaworks.plans import adapt
from plazaworks.plans.adapt import CENTER, WORDS, canon, contains, ctes, distance, tag_set, tokens, warsaw
from plazaworks.plans.registry import query, table

C = F.col
_R = "round({}, 6)"


@query("haversine", f"{ctes('places')} SELECT place_id, round({distance()}, 3) AS meters FROM places")
def haversine(spark, d):
    return adapt.places(spark, d).select("place_id", F.round(geo.haversine_m(C("lat"), C("lon"), F.lit(CENTER[0]), F.lit(CENTER[1])), 3).alias("meters"))


@query("viewport_radius", f"{ctes('places')} SELECT place_id, round(greatest(400, least(30000, 156543.03e0 * cos(radians(lat)) / pow(2e0, place_id % 23) * 600)), 4) AS radius FROM places")
def viewport_radius(spark, d):
    return adapt.places(spark, d).select("place_id", F.round(geo.viewport_radius_m(C("lat"), (C("place_id") % 23).cast("double")), 4).alias("radius"))


@query("distance_band", f"{ctes('places')} SELECT place_id, CASE WHEN {distance()} < 500 THEN 'within_500m' WHEN {distance()} < 2000 THEN 'within_2km' WHEN {distance()} < 5000 THEN 'within_5km' ELSE 'farther' END AS band FROM places")
def distance_band(spark, d):
    return adapt.places(spark, d).select("place_id", geo.distance_band(geo.haversine_m(C("lat"), C("lon"), F.lit(CENTER[0]), F.lit(CENTER[1]))).alias("band"))


@query("tokenize", f"SELECT p_partkey, array_to_string({tokens('p_name')}, ' ') AS tokens FROM part")
def tokenize(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.tokens(C("p_name")), " ").alias("tokens"))


_TRI = "list_distinct(flatten(list_transform({w}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def trigram_sql(a: str, b: str) -> str:
    x, y = (_TRI.format(w=WORDS.format(a=v)) for v in (a, b))
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0)::DOUBLE, 0)"


@query("trigram_similarity", f"SELECT a.item_id, {_R.format(trigram_sql('a.text', 'b.text'))} AS similarity FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def trigram_similarity(spark, d):
    items = table(spark, d, "benchmark")
    after = items.select((C("item_id") - 1).alias("item_id"), C("text").alias("next"))
    return items.join(after, "item_id").select("item_id", F.round(text.trigram_similarity(C("text"), C("next")), 6).alias("similarity"))


@query("warsaw_minute", f"{ctes('evs')} SELECT event_id, CAST({warsaw('starts_at')} AS BIGINT) AS minute FROM evs WHERE starts_at >= TIMESTAMP '1996-01-01'")
def warsaw_minute(spark, d):
    found = adapt.events(spark, d).filter(C("starts_at") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return found.select("event_id", time.warsaw_minute(C("starts_at")).cast("long").alias("minute"))


_WINDOWS = "SELECT c_custkey AS k, (c_custkey * 7) % 1443 AS s, (c_custkey * 13) % 1443 AS e, (c_custkey * 31) % 1440 AS m, (c_custkey * 17) % 1441 AS s2, (c_custkey * 11) % 1441 AS e2 FROM customer"


def _windows(spark, d):
    at = lambda f, n: F.pmod(C("c_custkey") * f, F.lit(n)).cast("int")
    return table(spark, d, "customer").select(C("c_custkey").alias("k"), at(7, 1443).alias("s"), at(13, 1443).alias("e"), at(31, 1440).alias("m"), at(17, 1441).alias("s2"), at(11, 1441).alias("e2"))


@query("window_contains", f"SELECT k, {contains('s', 'e', 'm')} AS inside FROM ({_WINDOWS})")
def window_contains(spark, d):
    return _windows(spark, d).select("k", time.window_contains(C("s"), C("e"), C("m")).alias("inside"))


@query("window_overlap", f"SELECT k, (SELECT bool_or({contains('s', 'e', 'x')} AND {contains('s2', 'e2', 'x')}) FROM range(1440) r(x)) AS meets FROM ({_WINDOWS})")
def window_overlap(spark, d):
    return _windows(spark, d).select("k", time.windows_overlap(C("s"), C("e"), C("s2"), C("e2")).alias("meets"))


@query("time_fit", f"SELECT k, CASE WHEN (e2 - s2 + 1440) % 1440 = 0 THEN 1e0 WHEN NOT {contains('s2', 'e2', 'm')} THEN 0e0 ELSE round(1 - abs((m - s2 + 1440) % 1440 - ((e2 - s2 + 1440) % 1440) / 2e0) / ((e2 - s2 + 1440) % 1440), 6) END AS fit FROM ({_WINDOWS})")
def time_fit(spark, d):
    return _windows(spark, d).select("k", F.round(time.time_fit(C("s2"), C("e2"), C("m")), 6).alias("fit"))


_PAIRS = "SELECT a.user_id, b.user_id AS other, a.age_band AS age, b.age_band AS age2, a.sportiness AS sport, b.sportiness AS sport2, a.tags AS tags, b.tags AS tags2 FROM people a JOIN people b ON b.user_id = a.user_id + 1"


def _pairs(spark, d):
    p = adapt.people(spark, d)
    q = p.select((C("user_id") - 1).alias("user_id"), C("user_id").alias("other"), C("age_band").alias("age2"), C("sportiness").alias("sport2"), C("tags").alias("tags2"))
    return p.withColumnsRenamed({"age_band": "age", "sportiness": "sport"}).join(q, "user_id")




@query("age_similarity", f"{ctes('people')} SELECT user_id, CAST({adapt.age_similarity('age', 'age2')} AS DOUBLE) AS similarity FROM ({_PAIRS})")
def age_similarity(spark, d):
    return _pairs(spark, d).select("user_id", similarity.age_similarity(C("age"), C("age2")).cast("double").alias("similarity"))


@query("sport_similarity", f"{ctes('people')} SELECT user_id, round({adapt.sport_similarity('sport', 'sport2')}, 6) AS similarity FROM ({_PAIRS})")
def sport_similarity(spark, d):
    return _pairs(spark, d).select("user_id", F.round(similarity.sport_similarity(C("sport"), C("sport2")), 6).alias("similarity"))


@query("tag_jaccard", f"{ctes('people')} SELECT user_id, round({adapt.tag_jaccard('tags', 'tags2')}, 6) AS jaccard FROM ({_PAIRS})")
def tag_jaccard(spark, d):
    return _pairs(spark, d).select("user_id", F.round(similarity.tag_jaccard(C("tags"), C("tags2")), 6).alias("jaccard"))


def company_sql(a: str, b: str) -> str:
    low = lambda t: f"list_bool_or(list_transform({t}, lambda t: regexp_matches(lower(t), 'lonely|lives alone|samotn')))"
    com = lambda t: f"list_bool_or(list_transform({t}, lambda t: regexp_matches(lower(t), 'wants company|towarzystwo')))"
    return f"(({low(a)} AND {com(b)}) OR ({low(b)} AND {com(a)}) OR ({com(a)} AND {com(b)} AND len(list_intersect({tag_set(a)}, {tag_set(b)})) > 0))"


@query("company_complement", f"{ctes('people')} SELECT user_id, {company_sql('tags', 'tags2')} AS complements FROM ({_PAIRS})")
def company_complement(spark, d):
    none = F.array().cast("array<string>")
    return _pairs(spark, d).select("user_id", similarity.company_complement(C("tags"), none, C("tags2"), none).alias("complements"))


def profile_sql(age1, age2, sport1, sport2, tags1, tags2) -> str:
    parts = [f"CAST({adapt.age_similarity(age1, age2)} AS DOUBLE)", adapt.sport_similarity(sport1, sport2), adapt.tag_jaccard(tags1, tags2), f"CASE WHEN {company_sql(tags1, tags2)} THEN 1e0 END"]
    return f"coalesce(list_avg(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), 0)"


@query("profile_similarity", f"{ctes('people')} SELECT user_id, round({profile_sql('age', 'age2', 'sport', 'sport2', 'tags', 'tags2')}, 6) AS similarity FROM ({_PAIRS})")
def profile_similarity(spark, d):
    none, vector = F.array().cast("array<string>"), F.lit(None).cast("array<double>")
    complements = similarity.company_complement(C("tags"), none, C("tags2"), none)
    found = similarity.profile_similarity((C("age"), C("age2")), (C("sport"), C("sport2")), (C("tags"), C("tags2")), (vector, vector), complements)
    return _pairs(spark, d).select("user_id", F.round(found, 6).alias("similarity"))


@query("shared_tags", f"{ctes('people')} SELECT user_id, array_to_string(list_transform(list_sort(list_filter(list_transform(tags, lambda t: {{'c': {canon('t')}, 'raw': t}}), lambda p: list_contains({tag_set('tags2')}, p.c))), lambda p: p.raw), ',') AS shared FROM ({_PAIRS})")
def shared_tags(spark, d):
    return _pairs(spark, d).select("user_id", F.array_join(similarity.shared_tags(C("tags"), C("tags2")), ",").alias("shared"))


@query("title_key", r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM documents")
def title_key(spark, d):
    return table(spark, d, "documents").select("doc_id", text.title_key(C("text")).alias("key"))


_ABS = f"CASE WHEN h = '' OR starts_with(h, '#') OR starts_with(h, 'javascript:') OR starts_with(h, 'mailto:') THEN NULL WHEN starts_with(h, 'https://') OR starts_with(h, 'http://') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN '{text.ORIGIN}' || h ELSE '{text.ORIGIN}/' || h END"
_HREFS = """SELECT page_id, i - 1 AS n, l[i] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l, unnest(range(1, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) + 1)) AS i FROM pages)"""


@query("extract_links", _HREFS)
def extract_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(library.links_of(C("html"))).alias("n", "href")).select("page_id", C("n").cast("long").alias("n"), "href")


@query("absolute_url", f"SELECT page_id, n, {_ABS} AS url FROM (SELECT page_id, n, trim(CASE n % 6 WHEN 0 THEN href WHEN 1 THEN '#' || href WHEN 2 THEN '/' || href WHEN 3 THEN ' mailto:' || href WHEN 4 THEN 'x' || href ELSE 'https:/' || href END) AS h FROM ({_HREFS}))")
def absolute_url(spark, d):
    href = F.expr("CASE n % 6 WHEN 0 THEN href WHEN 1 THEN concat('#', href) WHEN 2 THEN concat('/', href) WHEN 3 THEN concat(' mailto:', href) WHEN 4 THEN concat('x', href) ELSE concat('https:/', href) END")
    return extract_links(spark, d).select("page_id", "n", text.absolute_url(href).alias("url"))


_LINK_URL = "CASE page_id % 7 WHEN 0 THEN url || '/a.ZIP?x=1' WHEN 1 THEN url || '/b.pdf#p' WHEN 2 THEN 'https://youtu.be/' || page_id WHEN 3 THEN 'https://creativecommons.org/licenses/by-nc/4.0/' WHEN 4 THEN url || '/zasady' WHEN 5 THEN 'https://creativecommons.org/licenses/by-sa/4.0/' ELSE url END"


def _link_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.expr(_LINK_URL).alias("u"))


_CLASS = r"CASE WHEN contains(lower(u), 'youtube.com') OR contains(lower(u), 'youtu.be') OR contains(lower(u), 'vimeo.com') THEN 'video' WHEN contains(lower(u), 'creativecommons.org') OR contains(lower(u), 'zasady_wykorzystania') OR contains(lower(u), 'zasady-wykorzystania') THEN 'licence' WHEN ends_with(regexp_replace(lower(u), '[?#].*$', ''), '.zip') THEN 'zip' WHEN ends_with(regexp_replace(lower(u), '[?#].*$', ''), '.pdf') THEN 'pdf' ELSE 'other' END"


@query("classify_href", f"SELECT page_id, {_CLASS} AS kind FROM (SELECT page_id, {_LINK_URL} AS u FROM pages)")
def classify_href(spark, d):
    return _link_urls(spark, d).select("page_id", text.classify_href(C("u")).alias("kind"))


@query("licence_name", f"SELECT page_id, CASE WHEN contains(lower(u), 'creativecommons.org/licenses/by-nc-sa') THEN 'CC BY-NC-SA 4.0' WHEN contains(lower(u), 'creativecommons.org/licenses/by-nc') THEN 'CC BY-NC 4.0' WHEN contains(lower(u), 'creativecommons.org/licenses/by-sa') THEN 'CC BY-SA 4.0' WHEN contains(lower(u), 'creativecommons.org/licenses/by') THEN 'CC BY 4.0' WHEN contains(lower(u), 'miis') OR contains(lower(u), 'zasady') THEN 'Zasady wykorzystania innowacji MIIS' ELSE u END AS licence FROM (SELECT page_id, {_LINK_URL} AS u FROM pages)")
def licence_name(spark, d):
    return _link_urls(spark, d).select("page_id", text.licence_name(C("u")).alias("licence"))


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*(>|$)|>', '', 'g') AS text FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_tags(C("html")).alias("text"))


_TO_TEXT = r"regexp_replace(html, '(?i)</?(p|div|li|ul|ol|br|h[1-6]|tr|table|section|article)\b[^>]*>', chr(10), 'g')"
_TO_TEXT = f"regexp_replace({_TO_TEXT}, '<[^>]*(>|$)|>', '', 'g')"
for _name, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
    _TO_TEXT = f"replace({_TO_TEXT}, '{_name}', '{_char}')"
_TO_TEXT = rf"trim(regexp_replace(regexp_replace(regexp_replace({_TO_TEXT}, '[ \t\r\f]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))"


@query("html_text_len", f"SELECT page_id, length({_TO_TEXT}) AS n, md5({_TO_TEXT}) AS digest FROM pages")
def html_text_len(spark, d):
    read = table(spark, d, "pages").select("page_id", text.html_to_text(C("html")).alias("t"))
    return read.select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query("page_title", "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


_PATH = "replace(p_name, ' ', '/') || CASE p_partkey % 9 WHEN 0 THEN '/model.PDF' WHEN 1 THEN '/instrukcja.docx' WHEN 2 THEN '/Raport.odt' WHEN 3 THEN '/font.ttf' WHEN 4 THEN '/opis.txt' WHEN 5 THEN '/model wzorniczy.rtf' WHEN 6 THEN '/test.htm' WHEN 7 THEN '/x.zip' ELSE '' END"


def _paths(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", F.expr(_PATH).alias("path"))


_KIND = "CASE WHEN string_split(lower(path), '.')[-1] IN ('pdf', 'docx', 'odt', 'rtf') THEN string_split(lower(path), '.')[-1] WHEN string_split(lower(path), '.')[-1] IN ('txt', 'md', 'html', 'htm') THEN 'text' ELSE 'other' END"
_RANK = "CASE WHEN contains(p, 'font') OR ends_with(p, '.ttf') THEN 9 WHEN contains(p, 'model') AND NOT contains(p, 'wzorniczy') THEN 0 WHEN contains(p, 'instruk') OR contains(p, 'scenari') THEN 1 WHEN contains(p, 'test') THEN 2 WHEN contains(p, 'raport') THEN 3 WHEN contains(p, 'folder') OR contains(p, 'opis') THEN 4 WHEN contains(p, 'wzorniczy') THEN 8 ELSE 5 END"


@query("media_kind", f"SELECT p_partkey, {_KIND} AS kind FROM (SELECT p_partkey, {_PATH} AS path FROM part)")
def media_kind(spark, d):
    return _paths(spark, d).select("p_partkey", text.media_kind(C("path")).alias("kind"))


@query(
    "doc_priority",
    f"SELECT p_brand, path, row_number() OVER (PARTITION BY p_brand ORDER BY {_RANK}, CASE kind WHEN 'pdf' THEN 0 WHEN 'docx' THEN 1 WHEN 'odt' THEN 2 ELSE 3 END, path, p_partkey) AS n FROM (SELECT p_partkey, p_brand, path, lower(path) AS p, {_KIND} AS kind FROM (SELECT p_partkey, p_brand, {_PATH} AS path FROM part)) WHERE kind <> 'other'",
)
def doc_priority(spark, d):
    from pyspark.sql import Window as W

    read = _paths(spark, d).withColumn("kind", text.media_kind(C("path"))).filter("kind <> 'other'")
    order = W.partitionBy("p_brand").orderBy(text.path_rank(C("path")), text.kind_rank(C("kind")), "path", "p_partkey")
    return read.select("p_brand", "path", F.row_number().over(order).cast("long").alias("n"))


@query("cap_text", "SELECT doc_id, length(substring(text, 1, 2000)) AS n, md5(substring(text, 1, 2000)) AS digest, CASE WHEN length(text) > 2000 THEN 'cut to 2000 characters' END AS note FROM documents")
def cap_text(spark, d):
    read = table(spark, d, "documents").select("doc_id", text.capped(C("text"), 2000).alias("c"))
    return read.select("doc_id", F.length("c.text").cast("long").alias("n"), F.md5("c.text").alias("digest"), "c.note")


@query("text_window", "SELECT doc_id, md5(substring(text, doc_id % 500 + 1, 700)) AS digest, CASE WHEN doc_id % 500 + 700 < length(text) THEN doc_id % 500 + 700 END AS next_offset FROM documents")
def text_window(spark, d):
    read = table(spark, d, "documents").select("doc_id", text.text_window(C("text"), F.pmod("doc_id", F.lit(500)).cast("int"), 700).alias("w"))
    return read.select("doc_id", F.md5("w.part").alias("digest"), C("w.next_offset").cast("long").alias("next_offset"))


@query("page_sha256", "SELECT page_id, sha256(url || chr(10) || html) AS digest FROM pages")
def page_sha256(spark, d):
    return table(spark, d, "pages").select("page_id", library.fingerprint(C("url"), C("html")).alias("digest"))


_URL = "CASE page_id % 3 WHEN 0 THEN replace(url, '://', '://me:secret@') WHEN 1 THEN url ELSE replace(url, '://', '://:p@') END"


@query("redact_url", f"SELECT page_id, regexp_replace({_URL}, '://([^:/? ]*):[^/? ]*@', '://\\1:***@') AS url FROM pages")
def redact_url(spark, d):
    return table(spark, d, "pages").select("page_id", text.redacted_url(F.expr(_URL)).alias("url"))


@query("attendance_label", f"{ctes('evs', 'attendances', 'signed')} SELECT event_id, CASE WHEN capacity IS NULL THEN coalesce(n, 0)::VARCHAR ELSE coalesce(n, 0) || '/' || capacity END AS label FROM evs LEFT JOIN signed USING (event_id)")
def attendance_label(spark, d):
    from plazaworks.operators.joins import signed_counts

    read = adapt.events(spark, d).join(signed_counts(adapt.attendances(spark, d)), "event_id", "left")
    return read.select("event_id", text.attendance_label(F.coalesce("signed_count", F.lit(0)), C("capacity")).alias("label"))


_ADDRESS = "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE ' Road ' || s_nationkey END AS road, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_suppkey::VARCHAR END AS number, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'City' || s_nationkey END AS city, s_name AS shown FROM supplier"


@query(
    "address_line",
    f"SELECT s_suppkey, CASE WHEN street = '' AND city = '' THEN shown WHEN street = '' THEN city WHEN city = '' THEN street ELSE street || ', ' || city END AS line FROM (SELECT *, CASE WHEN trim(road) = '' THEN '' ELSE trim(trim(road) || ' ' || number) END AS street FROM ({_ADDRESS}))",
)
def address_line(spark, d):
    k = C("s_suppkey")
    road = F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" Road "), C("s_nationkey").cast("string")))
    number = F.when(k % 2 == 0, "").otherwise(k.cast("string"))
    city = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("City"), C("s_nationkey").cast("string")))
    return table(spark, d, "supplier").select("s_suppkey", text.address_line(road, number, city, C("s_name")).alias("line"))


@query("json_pairs", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_pairs(spark, d):
    notes = table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return notes


@query("cosine_topk", "SELECT e.vec_id AS chunk, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, 1 LIMIT 10")
def cosine_topk(spark, d):
    from plazaworks.operators.search import nearest

    chunks = adapt.chunks(spark, d)
    vector = chunks.filter("chunk = 0").first()["embedding"]  # the query's vector: one row
    return nearest(chunks, vector, 10).select("chunk", F.round("score", 6).alias("score"))


@query("in_region", f"{ctes('places')} SELECT place_id, lat + 0.2e0 BETWEEN 49.15 AND 50.52 AND lon BETWEEN 19.05 AND 21.50 AS inside FROM places")
def in_region(spark, d):
    return adapt.places(spark, d).select("place_id", geo.in_region(C("lat") + 0.2, C("lon")).alias("inside"))
