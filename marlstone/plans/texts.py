"""Text queries: names, rules, extraction, resolution, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import answers
from marlstone.functions import text as t
from marlstone.operators.knn import nearest, similarity_groups
from marlstone.operators.lookup import best_trigram_match, longest_contained, resolve
from marlstone.plans.registry import query
from marlstone.sources.tables import table

# Fixed values of the queries below.
LEXICON = {"and": "(^|[^a-z])and([^a-z]|$)", "license": "licen[cs]e", "mail": "@", "para": "(^|[^a-z])para([^a-z]|$)", "und": "(^|[^a-z])und([^a-z]|$)"}
VOCABULARY = ("the", "that", "this", "with", "from", "license", "und", "der", "die", "les", "des", "para", "como")
MODIFIERS = ("large", "small", "medium", "promo", "economy", "standard")


@query("SELECT p_partkey AS part, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as slugs."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), t.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("""WITH r AS (SELECT p_partkey AS part, regexp_replace(lower(CASE p_partkey % 4 WHEN 0 THEN 'Sr. ' || p_name || ' (' || p_type || ') II' WHEN 1 THEN 'Tech Lead, ' || p_name WHEN 2 THEN 'Staff' ELSE 'Vice  President of C++/' || p_name END), '[^a-z0-9+#./ ]+', ' ', 'g') AS r FROM part),
w AS (SELECT part, list_filter(string_split_regex(regexp_replace(r, '\\b(intern|graduate|grad|entry|junior|jr|associate|mid|senior|sr|staff|principal|prin|distinguished|fellow|vice\\s+president|i|ii|iii|iv|v|1|2|3|4)\\b', ' ', 'g'), ' +'), lambda x: regexp_matches(x, '[a-z0-9]')) AS w, list_filter(string_split_regex(r, ' +'), lambda x: regexp_matches(x, '[a-z0-9]')) AS every FROM r)
SELECT part, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE array_to_string(every, ' ') END AS surface FROM w""")
def normalized_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without seniority words."""
    kind = F.col("p_partkey") % 4
    title = F.when(kind == 0, F.concat(F.lit("Sr. "), "p_name", F.lit(" ("), "p_type", F.lit(") II"))).when(kind == 1, F.concat(F.lit("Tech Lead, "), "p_name")).when(kind == 2, "Staff").otherwise(F.concat(F.lit("Vice  President of C++/"), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), t.normalize_surface(title).alias("surface"))


@query("""SELECT s_suppkey AS supplier, trim(regexp_replace(regexp_replace(lower(s_name || ' Technologies Pvt. Ltd, Inc.'), '\\b(inc|llc|ltd|limited|gmbh|corp|co|company|plc|pvt|private|technologies|labs|group)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS employer FROM supplier""")
def normalized_employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names without legal forms."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), t.norm_employer(F.concat("s_name", F.lit(" Technologies Pvt. Ltd, Inc."))).alias("employer"))


@query("SELECT c_custkey AS customer, TRY_CAST(replace(replace(replace('$' || printf('%,d', CAST(floor(abs(c_acctbal)) AS bigint)), '$', ''), ',', ''), '%', '') AS double) AS amount, TRY_CAST(NULL AS double) AS missing FROM customer")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of formatted text, null for marks of no data."""
    shown = F.concat(F.lit("$"), F.format_number(F.floor(F.abs("c_acctbal")), 0))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), t.parse_number(shown).alias("amount"), t.parse_number(F.lit("n/a")).alias("missing"))


@query("""WITH u AS (SELECT o_orderkey AS id, o_totalprice AS v, CASE o_orderpriority WHEN '1-URGENT' THEN 'hour' WHEN '2-HIGH' THEN 'week' WHEN '3-MEDIUM' THEN 'month' WHEN '4-NOT SPECIFIED' THEN 'other' ELSE 'year' END AS unit FROM orders)
SELECT id, unit, round(CASE unit WHEN 'year' THEN v WHEN 'hour' THEN v * 2080 WHEN 'month' THEN v * 12 WHEN 'week' THEN v * 52 ELSE CASE WHEN v >= 20000 THEN v END END, 2) AS yearly FROM u""")
def annualised_pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pay by unit, made yearly."""
    p = F.col("o_orderpriority")
    unit = F.when(p == "1-URGENT", "hour").when(p == "2-HIGH", "week").when(p == "3-MEDIUM", "month").when(p == "4-NOT SPECIFIED", "other").otherwise("year")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), unit.alias("unit"))
    return rows.select("id", "unit", F.round(t.annualise(F.col("v"), F.col("unit")), 2).alias("yearly"))


@query("SELECT p_partkey AS part, round(CASE WHEN p_size * 40.0E0 >= p_retailprice THEN (p_retailprice + p_size * 40.0E0) / 2 ELSE p_retailprice END, 4) AS mid FROM part")
def band_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of a band, or its lower bound if the band is turned round."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.round(t.midpoint(F.col("p_retailprice"), F.col("p_size") * 40.0), 4).alias("mid"))


@query("""WITH h AS (SELECT p_partkey AS part, CASE p_size % 4 WHEN 0 THEN '20' || (10 + p_size // 10) || '-20' || (20 + p_size % 10 + p_size // 10) WHEN 1 THEN p_size || 'yr' WHEN 2 THEN 'current' ELSE 'long term' END AS horizon FROM part)
SELECT part, horizon, CASE WHEN regexp_matches(horizon, '^[0-9]{4}-[0-9]{4}$') THEN CAST(substr(horizon, 6, 4) AS int) - CAST(substr(horizon, 1, 4) AS int) WHEN horizon LIKE '%yr' THEN CAST(replace(horizon, 'yr', '') AS int) WHEN horizon <> 'current' THEN 10 END AS years FROM h""")
def parsed_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of a horizon's text."""
    s = F.col("p_size")
    tens = F.floor(s / 10)
    text = F.when(s % 4 == 0, F.concat(F.lit("20"), (tens + 10).cast("string"), F.lit("-20"), (20 + s % 10 + tens).cast("string"))).when(s % 4 == 1, F.concat(s.cast("string"), F.lit("yr"))).when(s % 4 == 2, "current").otherwise("long term")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), text.alias("horizon")).withColumn("years", t.horizon_years(F.col("horizon")))


@query("""SELECT p_partkey AS part, CASE WHEN regexp_matches(lower(p_name), 'blue|azure') THEN 'veto' WHEN regexp_matches(lower(p_name), 'red|green') AND NOT regexp_matches(lower(p_name), 'dark') THEN 'strong' WHEN regexp_matches(lower(p_type), 'promo') THEN 'soft' ELSE 'none' END AS class FROM part""")
def rule_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that holds."""
    name, kind = F.lower("p_name"), F.lower("p_type")
    rules = [(name.rlike("blue|azure"), "veto"), (name.rlike("red|green") & ~name.rlike("dark"), "strong"), (kind.rlike("promo"), "soft")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), t.ordered_rules(rules, "none").alias("class"))


@query("""SELECT source, lang, sum(CASE WHEN regexp_matches(lower(text), '(^|[^a-z])and([^a-z]|$)') THEN 1 ELSE 0 END)::bigint AS n_and, sum(CASE WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 1 ELSE 0 END)::bigint AS n_license, sum(CASE WHEN contains(text, '@') THEN 1 ELSE 0 END)::bigint AS n_mail,
sum(CASE WHEN regexp_matches(lower(text), '(^|[^a-z])para([^a-z]|$)') THEN 1 ELSE 0 END)::bigint AS n_para, sum(CASE WHEN regexp_matches(lower(text), '(^|[^a-z])und([^a-z]|$)') THEN 1 ELSE 0 END)::bigint AS n_und FROM documents GROUP BY ALL""")
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each name of a lexicon, by source and language; counted without exploding."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", t.lexicon(F.lower("text"), LEXICON).alias("names"))
    return docs.groupBy("source", "lang").agg(*[F.sum(F.array_contains("names", n).cast("long")).alias(f"n_{n}") for n in LEXICON])


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x IN ('the','that','this','with','from','license','und','der','die','les','des','para','como')) AS w FROM documents),
d AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS d FROM w) SELECT doc_id, array_to_string(d[1:12], ',') AS terms FROM d""")
def extracted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary words of each text, in order of appearance."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(t.extract_terms(F.col("text"), VOCABULARY), ",").alias("terms"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS bigint) AS n_shingles FROM w""")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct five-word shingles of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", t.words_of(F.col("text")).alias("words"))
    return docs.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size(t.shingles(F.col("words"))).cast("long").alias("n_shingles"))


@query("""WITH a AS (SELECT DISTINCT p_type AS entity, lower(p_type) AS alias FROM part), n AS (SELECT DISTINCT lower(p_brand || ' ' || p_name || ' ' || p_type) AS name FROM part UNION SELECT DISTINCT lower(p_type) FROM part)
SELECT name, entity, alias = name AS exact FROM n JOIN a ON alias = name OR (length(alias) >= 4 AND contains(' ' || name || ' ', ' ' || alias || ' ')) QUALIFY row_number() OVER (PARTITION BY name ORDER BY alias = name DESC, length(alias) DESC, alias, entity) = 1""")
def alias_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved to the longest alias that they hold as whole words."""
    part = table(spark, sf_dir, "part")
    aliases = part.select(F.col("p_type").alias("entity"), F.lower("p_type").alias("alias")).distinct()
    names = part.select(F.lower(F.concat_ws(" ", "p_brand", "p_name", "p_type")).alias("name")).union(part.select(F.lower("p_type"))).distinct()
    return longest_contained(names, "name", aliases)


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, unnest(list_distinct(list_transform(range(1, length(name) + 2), lambda i: substr('  ' || lower(name) || ' ', i, 3)))) AS t FROM n), c AS (SELECT name, count(*) AS k FROM g GROUP BY 1),
s AS (SELECT a.name AS name, b.name AS candidate, count(*) AS s FROM g a JOIN g b ON a.t = b.t AND a.name <> b.name GROUP BY ALL)
SELECT s.name, candidate, round(s / (x.k + y.k - s), 6) AS similarity FROM s JOIN c x ON s.name = x.name JOIN c y ON candidate = y.name QUALIFY row_number() OVER (PARTITION BY s.name ORDER BY round(s / (x.k + y.k - s), 6) DESC, candidate) = 1""")
def trigram_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all other names for each name, by the trigrams of the whole names."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return best_trigram_match(names, "name", names.withColumnRenamed("name", "candidate"), "candidate", others=True)


@query("""WITH q AS (SELECT DISTINCT p_name AS name, lower(split_part(p_name, ' ', 1)) AS f, lower(split_part(p_name, ' ', 2)) AS s FROM part) SELECT name, CASE WHEN starts_with(f, 'b') THEN 1.0E0 WHEN starts_with(s, 'b') THEN 0.9E0 END AS score FROM q WHERE starts_with(f, 'b') OR starts_with(s, 'b')""")
def typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by a prefix of the whole or of a word."""
    low, words = F.lower("name"), F.split(F.lower("name"), " ")
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    score = F.when(low.startswith("b"), 1.0).when(F.exists(words, lambda w: w.startswith("b")), 0.9)
    return names.withColumn("score", score).where("score is not null")


@query("""SELECT page_id, length(h) AS n_chars, md5(h) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) AS h FROM pages)""")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without markup, as length and digest."""
    return table(spark, sf_dir, "pages").select("page_id", t.strip_html(F.col("html")).alias("h")).select("page_id", F.length("h").cast("long").alias("n_chars"), F.md5("h").alias("digest"))


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, array_to_string(list_reverse(string_split(host, '.')), ',') AS surt, list_extract(string_split(path, '/'), -1) AS tail, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM u""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, reversed host, last path segment and a parameter of each page."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", t.host_of(url).alias("host"), t.surt(url).alias("surt"), t.tail_of(F.parse_url(url, F.lit("PATH"))).alias("tail"), F.parse_url(url, F.lit("QUERY"), F.lit("ref")).alias("ref"))


@query("""WITH j AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS bigint) AS k FROM events) SELECT k, count(*) AS n FROM j GROUP BY 1""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a field of their JSON properties."""
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, coalesce(list_max(list_transform(regexp_extract_all(lower(text || ' ' || turn || '+ years'), '([0-9]{1,2})[+]? *(?:years|yrs)', 1), lambda x: CAST(x AS int))), 4) AS years, regexp_matches(lower(text), '\\bremote\\b') AND NOT regexp_matches(lower(text), '\\b(no\\s+remote|not\\s+remote|on-?site\\s+only)\\b') AS remote FROM conversations""")
def years_and_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years mentioned in a turn, and whether remote work is offered."""
    text = F.concat_ws(" ", "text", F.concat(F.col("turn").cast("string"), F.lit("+ years")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.years_mentioned(text).alias("years"), t.remote_flag(F.col("text")).alias("remote"))


@query("""WITH m AS (SELECT o_orderkey AS id, 'Who is hiring? (' || monthname(o_orderdate) || ' ' || year(o_orderdate) || ')' AS title FROM orders)
SELECT regexp_extract(title, '([0-9]{4})', 1) || '-' || lpad(CAST(list_position(['january','february','march','april','may','june','july','august','september','october','november','december'], lower(regexp_extract(title, '[(]([A-Za-z]+) ', 1))) AS varchar), 2, '0') AS month, count(*) AS n FROM m GROUP BY 1""")
def month_from_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles counted by the month that they name."""
    title = F.concat(F.lit("Who is hiring? ("), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(")"))
    return table(spark, sf_dir, "orders").groupBy(t.month_of(title).alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS part, CASE WHEN lo >= 10000 AND hi <= 2000000 THEN lo END AS low, CASE WHEN lo >= 10000 AND hi <= 2000000 THEN hi END AS high FROM (SELECT p_partkey, (p_size + 9) * 1000.0E0 AS lo, (p_size + 59) * 1000.0E0 AS hi FROM part)""")
def pay_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low and high of a band's text."""
    text = F.concat(F.lit("pays $"), (F.col("p_size") + 59).cast("string"), F.lit("k - "), (F.col("p_size") + 9).cast("string"), F.lit("k a year"))
    low, high = t.pay_band(text)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), low.alias("low"), high.alias("high"))


@query("""SELECT c_custkey AS customer, CASE WHEN length(s) > 3 THEN reverse(regexp_replace(regexp_replace(reverse(substr(s, 1, length(s) - 3)), '([0-9]{2})', '\\1,', 'g'), ',$', '')) || ',' || right(s, 3) ELSE s END AS shown FROM (SELECT c_custkey, CAST(CAST(floor(abs(c_acctbal) * 1000) AS bigint) AS varchar) AS s FROM customer)""")
def indian_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with digits set apart in twos."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), t.indian_digits(F.floor(F.abs("c_acctbal") * 1000)).alias("shown"))


@query("""WITH c AS (SELECT source, lang, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS size, count(*) AS n FROM documents GROUP BY ALL) SELECT source, lang, size, n, substr(sha1(source || chr(0) || lang), 1, 16) AS id FROM c""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, language and size class, with a stable id."""
    n = F.col("n_chars")
    size = F.when(n < 500, "short").when(n < 3000, "middle").otherwise("long")
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang", size.alias("size")).agg(F.count("*").alias("n"))
    return counts.withColumn("id", F.substring(F.sha1(F.concat("source", F.lit("\0"), "lang")), 1, 16))


@query("""WITH p AS (SELECT p_partkey AS part, list_sort(list_distinct(string_split(p_name, ' '))) AS s FROM part), r AS (SELECT p_type AS family, list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))) AS s, p_size FROM part WHERE p_size = 1 GROUP BY ALL), j AS (SELECT p.part, p_type AS family, p.s, r.s AS ref FROM p JOIN part ON part = p_partkey JOIN r ON r.family = p_type)
SELECT family, count(*) AS n, round(avg(len(list_intersect(s, ref)) / len(s)), 6) AS prec, round(avg(len(list_intersect(s, ref)) / len(ref)), 6) AS recall, round(avg(len(list_intersect(s, ref)) / (len(s) + len(ref) - len(list_intersect(s, ref)))), 6) AS jaccard FROM j GROUP BY 1""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean precision, recall and Jaccard similarity of sets against a reference set."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("family"), "p_size", F.array_distinct(F.split("p_name", " ")).alias("s"))
    reference = part.where("p_size = 1").groupBy("family").agg(F.array_distinct(F.flatten(F.collect_set("s"))).alias("ref"))
    both = part.join(reference, "family")
    shared = F.size(F.array_intersect("s", "ref"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return both.groupBy("family").agg(F.count("*").alias("n"), mean(shared / F.size("s"), "prec"), mean(shared / F.size("ref"), "recall"), mean(shared / F.size(F.array_union("s", "ref")), "jaccard"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS double[]) AS x FROM embeddings), q AS (SELECT vec_id AS query_id, x AS y FROM v WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y)), 9) AS similarity FROM q JOIN v ON query_id <> vec_id)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.3 QUALIFY rank <= 5""")
def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 100 its five nearest."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding").withColumn("similarity", F.round(F.col("similarity") * 1_000_000) / 1_000_000)


@query()
def similarity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors that are linked by a high cosine."""
    groups = similarity_groups(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return groups.withColumn("size", F.count("*").over(Window.partitionBy("group")))


@query("""SELECT p_partkey AS part, CASE WHEN regexp_matches(lower(p_name), '(^| )red( |$)') THEN 'FR' WHEN regexp_matches(lower(p_name), '(^| )(blue|azure)( |$)') THEN 'US' WHEN regexp_matches(p_brand, '1$') THEN 'IN' ELSE NULL END AS market FROM part""")
def market_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market by the first of several hints: words, then the end of the code."""
    name = F.lower("p_name")
    rules = [(name.rlike("(^| )red( |$)"), "FR"), (name.rlike("(^| )(blue|azure)( |$)"), "US"), (F.col("p_brand").rlike("1$"), "IN")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), t.ordered_rules(rules).alias("market"))


@query("""WITH d AS (SELECT doc_id, list_filter(string_split(trim(replace(replace(replace('<' || source || '><' || lang || '><meta>', '><', '|'), '<', ''), '>', ''), '|'), '|'), lambda x: x <> 'meta') AS tags FROM documents), e AS (SELECT unnest(tags) AS tag FROM d)
SELECT tag, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 50""")
def tag_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by tag, from tag lists in angle brackets, without meta tags and rare ones."""
    raw = F.concat(F.lit("<"), "source", F.lit("><"), "lang", F.lit("><meta>"))
    return table(spark, sf_dir, "documents").select(F.explode(t.tag_list(raw, drop=("meta",))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where("n >= 50")


@query("""WITH m AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), h AS (SELECT conv_id, turn, list_sort(list_filter(['the','with','des','der','para'], lambda w: regexp_matches(t, '(^|[^a-z])' || w || '([^a-z]|$)'))) AS skills FROM m)
SELECT conv_id, turn, array_to_string(skills, ',') AS skills, CAST(least(greatest(30 + 16 * len(skills), 20), 98) AS bigint) AS axis FROM h""")
def resume_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that a text names, and an axis that grows with their number within bounds."""
    aliases = {w: f"(^|[^a-z]){w}([^a-z]|$)" for w in ("the", "with", "des", "der", "para")}
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.lexicon(F.lower("text"), aliases).alias("s"))
    return rows.select("conv_id", "turn", F.array_join("s", ",").alias("skills"), F.least(F.greatest(30 + 16 * F.size("s"), F.lit(20)), F.lit(98)).cast("long").alias("axis"))


@query("""WITH r AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS int) AS k, event_type FROM events) SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'unknown' END AS kind, CASE WHEN k BETWEEN 0 AND 60 THEN k END AS years FROM r""")
def coerced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records held to a schema: unknown words and numbers out of range don't pass."""
    fields = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", t.coerce_word(F.col("event_type"), ("click", "view", "purchase")).alias("kind"), t.coerce_range(fields["k"], 0, 60).alias("years"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), q AS (SELECT name, CASE WHEN name > 't' THEN 0.9 WHEN name > 'm' THEN 0.6 ELSE 0.3 END AS score FROM n) SELECT name, CASE WHEN score >= 0.82 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS band FROM q""")
def resolution_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence bands of scores."""
    name = F.col("name")
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    score = F.when(name > "t", 0.9).when(name > "m", 0.6).otherwise(0.3)
    return names.select("name", F.when(score >= 0.82, "high").when(score >= 0.55, "medium").otherwise("low").alias("band"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 6 WHEN 1 THEN '0-2' WHEN 2 THEN '3-5' WHEN 3 THEN '6-9' WHEN 4 THEN '10+' WHEN 5 THEN '0-2' END AS band, CASE WHEN l_extendedprice <= 0 THEN 'sal-unknown' WHEN l_extendedprice * 3 < 40000 THEN 'sal-0' WHEN l_extendedprice * 3 < 75000 THEN 'sal-1' WHEN l_extendedprice * 3 < 120000 THEN 'sal-2' WHEN l_extendedprice * 3 < 180000 THEN 'sal-3' WHEN l_extendedprice * 3 < 260000 THEN 'sal-4' ELSE 'sal-5' END AS pay FROM lineitem""")
def wage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience bands of wage levels, and coarse pay tokens."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("none", "I", "Level II", "3", " iv ", "Entry")]), (F.col("l_linenumber") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), t.wage_band(level).alias("band"), t.pay_token(F.col("l_extendedprice") * 3).alias("pay"))


@query("""WITH s AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT lower(p_brand)))[1:12] AS skills, max(l_extendedprice) AS pay FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey AS id, 'order ' || lower(o_orderstatus) || ' || ' || array_to_string(list_transform(skills, lambda x: trim(x)), ' ') || ' || ' || lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) || ' || ' || CASE WHEN pay < 40000 THEN 'sal-0' WHEN pay < 75000 THEN 'sal-1' ELSE 'sal-2' END AS document FROM orders JOIN s ON o_orderkey = k""")
def composite_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's status, brands, priority and pay token as one text."""
    brands = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    brands = brands.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("p_brand").alias("skills"), F.max("l_extendedprice").alias("pay"))
    status = F.concat(F.lit("Senior Order ("), "o_orderstatus", F.lit(")"))
    return table(spark, sf_dir, "orders").join(brands, "o_orderkey").select(F.col("o_orderkey").alias("id"), t.composite_document(status, F.col("skills"), F.regexp_replace("o_orderpriority", "^[0-9]-", ""), F.col("pay")).alias("document"))


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), d AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9+#./-]+')) AS w FROM benchmark), q AS (SELECT name, list_distinct(regexp_extract_all(lower(name || ' the and'), '[a-z0-9+#./-]+')) AS w FROM n)
SELECT name, item_id, len(list_intersect(q.w, d.w)) / len(q.w) AS score FROM q JOIN d ON len(list_intersect(q.w, d.w)) > 0""")
def token_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each name's words in each benchmark item, where they share one."""
    name = F.concat("name", F.lit(" the and"))
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9+#./-]+"), F.lit(0))))
    names, items = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct(), table(spark, sf_dir, "benchmark")
    both = names.select("name", words(name).alias("w")).join(items.select("item_id", words(F.col("text")).alias("w")), "w").select("name", "item_id").distinct()
    return both.join(items, "item_id").select("name", "item_id", t.token_overlap(name, F.col("text")).alias("score"))


@query()
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' market segments, clipped and misspelt, resolved to part names and segments: exact, then by similarity."""
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_name").alias("id")).distinct()
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    aliases = parts.unionByName(segments.select(F.col("c_mktsegment").alias("alias"), F.col("c_mktsegment").alias("id")))
    asked = segments.select(F.explode(F.array("c_mktsegment", F.concat(F.lit("Senior "), F.substring("c_mktsegment", 1, 5)), F.concat(F.lit("x"), F.reverse("c_mktsegment")))).alias("query"))
    return resolve(asked.unionByName(parts.select(F.concat(F.substring("alias", 2, 20), F.lit("s")).alias("query"))), aliases)


ANSWER_SKILLS = ("sql", "python", "7")


@query(r"""WITH k AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, (conv_id + turn) % 6 AS kind FROM conversations), g AS (SELECT *, kind IN (0, 1, 4) AS good, kind IN (0, 1, 4, 5) AS obj FROM k)
SELECT conv_id, turn, obj AS is_object, CASE WHEN good AND role IN ('user', 'assistant') THEN role ELSE 'unknown' END AS role, CASE WHEN good THEN 'sql,python,7' ELSE '' END AS skills, CASE WHEN good THEN 'Rust,Zig' ELSE '' END AS emerging, CASE WHEN good THEN 'en,de' ELSE '' END AS languages,
CASE WHEN good AND turn <= 5 THEN CAST(turn AS int) END AS years, CASE WHEN good THEN nullif(text[1:40], '') WHEN kind = 5 THEN 'x' END AS summary, kind = 5 OR (good AND turn % 2 = 1) AS abstain FROM g""")
def recovered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made answers on each turn, whole, in chatter, in a list, broken or of wrong types, held to their schema."""
    role, turn, text = (F.col(c) for c in ("role", "turn", "text"))
    skills = F.array(F.lit("SQL"), F.lit(" python "), F.lit("cobol"), F.lit("7"), F.lit(""))
    body = F.to_json(F.struct(F.upper(role).alias("role"), skills.alias("skills"), F.array(F.lit("Rust"), F.lit(" "), F.lit("Zig"), F.lit("C3")).alias("emerging"), F.array(F.lit("EN"), F.lit("deu"), F.lit("e1"), F.lit("en"), F.lit("d")).alias("languages"), (turn + 0.5).alias("years"), text.alias("summary"), (turn % 2 == 1).alias("abstain")))
    body = F.replace(body, F.lit('"deu"'), F.lit('"de"'))
    kinds = [body, F.concat(F.lit("Sure! Here it is:\n"), body, F.lit("\nHope that helps")), F.substring(body, 1, 30), F.lit("[1, 2]"), F.concat(F.lit("["), body, F.lit("]")), F.lit('{"role": 5, "skills": "sql", "years": "12", "abstain": 1, "summary": " x "}')]
    raw = F.element_at(F.array(*kinds), ((F.col("conv_id") + turn) % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.recovered(raw).alias("a"))
    a = F.col("a")
    joined = lambda c: F.array_join(c, ",")
    return rows.select(
        "conv_id", "turn", a.isNotNull().alias("is_object"), answers.word_of(a, "role", ("user", "assistant"), "unknown").alias("role"), joined(answers.words_of(a, "skills", ANSWER_SKILLS)).alias("skills"), joined(answers.words_of(a, "emerging", most=2)).alias("emerging"),
        joined(answers.codes_of(a, "languages", 8)).alias("languages"), answers.number_of(a, "years", 0, 6).alias("years"), answers.text_of(a, "summary", 40).alias("summary"), answers.flag_of(a, "abstain").alias("abstain"),
    )
