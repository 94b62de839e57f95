"""Scalar function families: string, date, math, array, JSON, vector, text, HTML and dialogue; reachability over links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.registering import Queries
from millrace.sources.scratch import fresh_path
from millrace.sources.tables import table

query = Queries()


@query("SELECT p_partkey, upper(p_name) AS up, substring(p_name, 2, 3) AS sub, lpad(p_partkey::VARCHAR, 8, '0') AS padded, replace(p_name, 'a', '_') AS rep, translate(p_type, 'AE', '43') AS tr, reverse(p_brand) AS rev, split_part(p_name, ' ', 1) AS word, levenshtein(p_brand, 'Brand#11') AS lev, md5(p_name) AS digest, regexp_replace(p_name, '[aeiou]', '', 'g') AS cons FROM part")
def strings(spark, d) -> DataFrame:
    c = F.col
    return table(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.substring("p_name", 2, 3).alias("sub"), F.lpad(c("p_partkey").cast("string"), 8, "0").alias("padded"), F.replace(c("p_name"), F.lit("a"), F.lit("_")).alias("rep"), F.translate("p_type", "AE", "43").alias("tr"), F.reverse("p_brand").alias("rev"), F.split_part(c("p_name"), F.lit(" "), F.lit(1)).alias("word"), F.levenshtein(c("p_brand"), F.lit("Brand#11")).cast("long").alias("lev"), F.md5("p_name").alias("digest"), F.regexp_replace("p_name", "[aeiou]", "").alias("cons"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, year(o_orderdate) AS y, quarter(o_orderdate) AS q, last_day(o_orderdate) AS eom, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, o_orderdate + INTERVAL 36 HOUR AS later, dayofweek(o_orderdate) + 1 AS dow FROM orders")
def dates(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_trunc("month", t).cast("timestamp_ntz").alias("month"), F.year(t).cast("long").alias("y"), F.quarter(t).cast("long").alias("q"), F.last_day(t).alias("eom"), F.datediff(t, F.lit("1992-01-01").cast("date")).cast("long").alias("days"), (t + F.expr("interval 36 hours")).alias("later"), F.dayofweek(t).cast("long").alias("dow"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS root, round(ln(l_extendedprice), 9) AS ln, l_orderkey % 7 AS m, floor(l_tax * 100) AS fl, greatest(l_discount, l_tax) AS hi, round_even(l_extendedprice, 1) AS even, l_quantity / nullif(l_discount, 0) AS ratio FROM lineitem")
def maths(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sqrt("l_extendedprice"), 6).alias("root"), F.round(F.ln("l_extendedprice"), 9).alias("ln"), F.pmod("l_orderkey", F.lit(7)).alias("m"), F.floor(c("l_tax") * 100).cast("double").alias("fl"), F.greatest("l_discount", "l_tax").alias("hi"), F.bround("l_extendedprice", 1).alias("even"), F.try_divide("l_quantity", "l_discount").alias("ratio"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, len(w) AS n, list_distinct(list_transform(list_slice(w, 1, 5), lambda x: lower(x))).list_sort() AS head, len(list_filter(w, lambda x: len(x) > 5)) AS long_words, list_position(w, 'the') AS at FROM w
""")
def arrays(spark, d):
    w = F.split("text", " ")
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.array_sort(F.array_distinct(F.transform(F.slice(w, 1, 5), F.lower))).alias("head"), F.size(F.filter(w, lambda x: F.length(x) > 5)).cast("long").alias("long_words"), F.nullif(F.array_position(w, F.lit("the")).cast("int"), F.lit(0)).alias("at"))


@query("SELECT event_id, (props ->> '$.k')::INT AS k, (props ->> '$.missing') AS missing FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT key, sum(value::BIGINT)::BIGINT AS total, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key, (props ->> '$.k') AS value FROM events) GROUP BY key")
def maps(spark, d):
    m = F.from_json("props", "map<string,long>")
    return table(spark, d, "events").select(F.explode(m).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


@query("SELECT a.label, a.vec_id AS q, b.vec_id AS v, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cos FROM embeddings a JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) m ON a.vec_id = m.vec_id JOIN embeddings b ON a.label = b.label")
def cosine_to_first(spark, d):
    """Each vector's cosine with the first of its label; of rows that repeat the first id, one is the first."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by(F.struct(F.col("vec_id").alias("q"), F.col("embedding").alias("x")), "vec_id").alias("f")).select("label", "f.q", "f.x")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = F.col("x"), F.col("embedding")
    return e.join(first, "label").select("label", "q", F.col("vec_id").alias("v"), F.round(dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)), 5).alias("cos"))


@query("SELECT doc_id, len(text) AS chars, len(regexp_replace(text, '[A-Za-z]', '', 'g')) AS other, regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS has_mail, regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '<mail>', 'g') = text AS same FROM documents")
def text_profile(spark, d):
    mail = "[A-Za-z0-9._]+@[A-Za-z0-9.]+"
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.length(F.regexp_replace("text", "[A-Za-z]", "")).cast("long").alias("other"), F.col("text").rlike(mail).alias("has_mail"), (F.regexp_replace("text", mail, "<mail>") == F.col("text")).alias("same"))


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(*) >= 3")
def repeated_lines(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''").groupBy("line").agg(F.count("*").alias("n")).filter("n >= 3")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '//([^/?#]+)', 1) AS host, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS links FROM pages")
def page_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "//([^/?#]+)", 1).alias("host"), F.regexp_count("html", F.lit('href="([^"]*)"')).cast("long").alias("links"))


@query("SELECT conv_id, count(*) AS turns, count_if(role = before)::BIGINT AS repeats, min(turn) AS first, string_agg(role, '>' ORDER BY turn) AS roles FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id")
def dialogue(spark, d):
    t = table(spark, d, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ">")
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == F.col("before")).alias("repeats"), F.min("turn").alias("first"), roles.alias("roles"))


@query("SELECT p_partkey, substr(p_name, 1, 1) AS initial, regexp_extract(p_brand, '#([0-9]+)', 1) AS number, regexp_extract_all(p_type, '[A-Z]+') AS kinds, rtrim(p_name, 'aeiou') AS trimmed, position('a' IN p_name)::INT AS at, repeat('ab', 2) AS twice, starts_with(p_type, 'S') AS s, base64(encode(p_brand)) AS b64, hex(encode(p_brand)) AS hexes, ascii(p_name) AS code, concat_ws('-', p_brand, p_type) AS joined, len(p_name) - len(replace(p_name, 'o', '')) AS os FROM part")
def strings_more(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", F.left(c("p_name"), F.lit(1)).alias("initial"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("number"), F.regexp_extract_all("p_type", F.lit("([A-Z]+)"), F.lit(1)).alias("kinds"), F.rtrim("p_name", F.lit("aeiou")).alias("trimmed"), F.instr("p_name", "a").alias("at"), F.repeat(F.lit("ab"), 2).alias("twice"), F.startswith(c("p_type"), F.lit("S")).alias("s"), F.base64(c("p_brand").cast("binary")).alias("b64"), F.hex("p_brand").alias("hexes"), F.ascii("p_name").alias("code"), F.concat_ws("-", "p_brand", "p_type").alias("joined"), (F.length("p_name") - F.length(F.replace(c("p_name"), F.lit("o"), F.lit("")))).cast("long").alias("os"))


@query("SELECT o_orderkey, (o_orderdate + INTERVAL 2 MONTH)::DATE AS later, strftime(o_orderdate, '%Y/%m/%d') AS shown, weekofyear(o_orderdate) AS week, dayofyear(o_orderdate) AS doy, hour(o_orderdate) AS h, epoch(o_orderdate)::BIGINT AS secs, make_date(year(o_orderdate), 1, 1) AS new_year, monthname(o_orderdate)[1:3] AS name FROM orders")
def dates_more(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.add_months(t, 2).alias("later"), F.date_format(t, "yyyy/MM/dd").alias("shown"), F.weekofyear(t).cast("long").alias("week"), F.dayofyear(t).cast("long").alias("doy"), F.hour(t).cast("long").alias("h"), F.unix_timestamp(t.cast("timestamp")).alias("secs"), F.make_date(F.year(t), F.lit(1), F.lit(1)).alias("new_year"), F.monthname(t).alias("name"))


@query("SELECT p_partkey, round(pow(p_size, 1.5), 6) AS power, round(log10(p_retailprice), 9) AS lg, floor((p_retailprice - 900) / 200)::INT + 1 AS bucket, sign(p_size - 25) AS side, round(exp(p_size / 50.0), 9) AS e, p_size & 12 AS bits, p_size << 2 AS shifted, round(degrees(p_size), 6) AS deg, abs(p_size - 30) AS away, round(cbrt(p_size), 9) AS cube, p_size % 3 AS rest FROM part")
def maths_more(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", F.round(F.pow("p_size", F.lit(1.5)), 6).alias("power"), F.round(F.log10("p_retailprice"), 9).alias("lg"), F.floor((c("p_retailprice") - 900) / 200).cast("int").alias("b"), F.signum(c("p_size") - 25).alias("side"), F.round(F.exp(c("p_size") / 50.0), 9).alias("e"), c("p_size").bitwiseAND(12).alias("bits"), F.shiftleft("p_size", 2).alias("shifted"), F.round(F.degrees(c("p_size").cast("double")), 6).alias("deg"), F.abs(c("p_size") - 30).alias("away"), F.round(F.cbrt(c("p_size").cast("double")), 9).alias("cube"), (c("p_size") % 3).alias("rest")).withColumn("bucket", c("b") + 1).drop("b")


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
SELECT doc_id, list_sort(list_distinct(list_intersect(w, ['the', 'a', 'of', 'and']))) AS common, list_contains(w, 'the') AS has, len(list_distinct(w)) AS kinds, list_sum(list_transform(w, lambda x: len(x)))::BIGINT AS letters, list_reverse(w)[1] AS last,
  list_max(list_transform(w, lambda x: len(x))) AS longest, len(flatten([w, w])) AS twice FROM w
""")
def arrays_more(spark, d):
    w = F.col("w")
    sizes = F.transform(w, lambda x: F.length(x).cast("long"))
    return table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w")).select("doc_id", F.array_sort(F.array_intersect(F.array(*[F.lit(x) for x in ("the", "a", "of", "and")]), w)).alias("common"), F.array_contains(w, "the").alias("has"), F.size(F.array_distinct(w)).cast("long").alias("kinds"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("letters"), F.element_at(F.reverse(w), 1).alias("last"), F.array_max(sizes).alias("longest"), F.size(F.flatten(F.array(w, w))).cast("long").alias("twice"))


@query("SELECT conv_id, turn, (i - 1)::INT AS at, word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations)")
def words_with_places(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("at", "word"))


@query("SELECT event_id, json_object('k', (props ->> '$.k')::INT, 'type', event_type)::VARCHAR AS made, (props ->> '$.k') AS k, map_keys(MAP {'a': 1, event_type: 2}) AS names, MAP {'a': 1, event_type: 2}['a'] AS a FROM events")
def json_and_maps(spark, d):
    # A map has no null keys: an event without a type has no map.
    m = F.when(F.col("event_type").isNotNull(), F.create_map(F.lit("a"), F.lit(1), F.col("event_type"), F.lit(2)))
    return table(spark, d, "events").select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("type"))).alias("made"), F.json_tuple("props", "k").alias("k"), F.map_keys(m).alias("names"), F.element_at(m, "a").alias("a"))


@query("SELECT event_id, (props ->> '$.k')::INT AS k, (props ->> '$.k')::INT > 2 AS over FROM events")
def variant_fields(spark, d):
    v = F.variant_get(F.parse_json("props"), "$.k", "int")
    return table(spark, d, "events").select("event_id", v.alias("k"), (v > 2).alias("over"))


#: What is masked, in order, and by what.
MASKS = (("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "<mail>"), ("AKIA[0-9A-Z]{16}", "<key>"), ("[0-9]{3}-[0-9]{2}-[0-9]{4}", "<number>"), ("[0-9]{1,3}([.][0-9]{1,3}){3}", "<address>"))


@query("SELECT doc_id, " + "regexp_replace(" * len(MASKS) + "text" + "".join(f", '{p}', '{m}', 'g')" for p, m in MASKS) + " AS redacted, " + ", ".join(f"regexp_matches(text, '{p}') AS has_{m[1:-1]}" for p, m in MASKS) + " FROM documents")
def redacted_text(spark, d):
    """Texts with mail addresses, access keys, numbers of people and network addresses masked."""
    text = F.col("text")
    for p, m in MASKS:
        text = F.regexp_replace(text, p, m)
    return table(spark, d, "documents").select("doc_id", text.alias("redacted"), *[F.col("text").rlike(p).alias(f"has_{m[1:-1]}") for p, m in MASKS])


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT DISTINCT href, page_id FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = l.href)")
def dead_links(spark, d):
    pages = table(spark, d, "pages")
    return page_links(spark, d).distinct().join(pages.select(F.col("url").alias("href")).distinct(), "href", "left_anti").select("href", "page_id")


_TAGS = "<[^>]*>"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '{_TAGS}', ' ', 'g'), '[ \\n\\t\\r]+', ' ', 'g')) AS body FROM pages")
def page_text(spark, d):
    h = F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(h, _TAGS, " "), "[ \\n\\t\\r]+", " ")).alias("body"))


MOST_HOPS = 6


@query(f"""
WITH RECURSIVE l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages WHERE page_id IS NOT NULL),
r(page_id, hops) AS (SELECT min(page_id), 0 FROM pages HAVING min(page_id) IS NOT NULL UNION SELECT b.page_id, hops + 1 FROM r JOIN l a ON a.page_id = r.page_id JOIN l b ON b.href = a.href WHERE hops < {MOST_HOPS})
SELECT page_id, min(hops)::INT AS hops FROM r GROUP BY page_id
""")
def reachability(spark, d):
    """Pages within MOST_HOPS of the one with the smallest id; pages that hold one link are a hop apart.

    Breadth first from pages to links and back: a link is followed once, so pairs of pages are never made. Each level is
    written out. Rows without an id are no pages.
    """

    def written(df, label):
        path = fresh_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    links = written(page_links(spark, d).filter("page_id is not null").distinct(), "reach-links")
    start = table(spark, d, "pages").agg(F.min("page_id").alias("page_id")).filter("page_id is not null")
    level = written(start.withColumn("hops", F.lit(0)), "reach-pages")
    pages, followed = level, spark.createDataFrame([], "href string")
    for hop in range(1, MOST_HOPS + 1):
        if level.isEmpty():
            break
        hrefs = written(links.join(level, "page_id").select("href").distinct().join(followed, "href", "left_anti"), "reach-hrefs")
        level = links.join(hrefs, "href").select("page_id").distinct().join(pages, "page_id", "left_anti")
        level = written(level.withColumn("hops", F.lit(hop)), "reach-pages")
        pages, followed = pages.union(level), followed.union(hrefs)
    return pages


QUERIES, SQL = query.queries, query.sql
