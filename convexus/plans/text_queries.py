"""Queries over texts: buckets, labels, prompts and word interventions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators.blocks import block_join
from ..registry import query
from ..sources.staging import staged
from ..sources.tables import table

WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')"
MARKS = "not|no|never|none|nothing|nowhere|hardly|barely|scarcely|without"
NEG = rf"'n''t| ({MARKS}) |^({MARKS}) | ({MARKS})$'"


@query("context_buckets", f"""WITH b AS (SELECT lang, len({WORDS}) AS n, regexp_matches(lower(text), {NEG}) AS neg FROM documents WHERE text IS NOT NULL)
SELECT lang, CASE WHEN n <= 7 THEN 'short' WHEN n <= 15 THEN 'medium' ELSE 'long' END AS bucket, neg, count(*) AS n_docs, round(avg(n), 6) AS mean_words FROM b GROUP BY ALL""")  # fmt: skip
def context_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("lang", F.size(text.words(F.col("text"))).alias("n"), text.has_negation(F.col("text")).alias("neg"))
    return d.groupBy("lang", text.bucket_length(F.col("n")).alias("bucket"), "neg").agg(F.count("*").alias("n_docs"), F.round(F.avg("n"), 6).alias("mean_words"))


@query("negation_flag", f"SELECT conv_id, turn, role, regexp_matches(lower(text), {NEG}) AS negated FROM conversations")
def negation_flag(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.has_negation(F.col("text")).alias("negated"))


@query("contains_folded", r"""WITH d AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS f FROM benchmark),
c AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS f FROM conversations)
SELECT item_id, conv_id, turn FROM d JOIN c ON length(d.f) > 0 AND contains(c.f, d.f)""")  # fmt: skip
def contains_folded(spark, sf_dir):
    """Turns whose folded text holds an item's, anywhere.

    The words of an item but its first and last are whole words of any text that holds it, so an item of three words
    or more meets only the texts with the rarest of its inner grams: three words, or one in items of three or four.
    Shorter items meet all texts. Each distinct text is tested once.
    """

    def threes(w):
        later = lambda k: F.slice(w, F.lit(k), F.greatest(F.size(w), F.lit(1)))
        two = lambda a, b: F.concat(a, F.lit(" "), b)
        return F.filter(F.zip_with(F.zip_with(w, later(2), two), later(3), two), lambda g: g.isNotNull())

    items = table(spark, sf_dir, "benchmark").select("item_id", text.fold(F.col("text")).alias("needle")).where(F.length("needle") > 0).withColumn("w", F.split("needle", " "))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.fold(F.col("text")).alias("f")).where("f IS NOT NULL").withColumn("h", F.sha2("f", 256))
    texts = turns.select("h", "f").dropDuplicates(["h"])
    inner = F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0)))
    want = items.where(F.size("w") >= 3).select("item_id", "needle", F.explode(F.when(F.size("w") >= 5, threes(inner)).otherwise(inner)).alias("g"))
    split = F.split("f", " ")
    there = texts.select("h", F.explode(F.array_distinct(F.concat(split, threes(split)))).alias("g")).join(want.select("g").distinct(), "g", "left_semi")
    rare = want.join(there.groupBy("g").agg(F.count("*").alias("n")), "g", "left").groupBy("item_id", "needle").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    held = F.contains("f", "needle")
    long = rare.join(there, "g").select("item_id", "needle", "h").join(texts, "h").where(held).select("item_id", "h")
    short = items.where(F.size("w") < 3).select("item_id", "needle").join(texts, held).select("item_id", "h")
    return long.unionByName(short).join(turns.select("h", "conv_id", "turn"), "h").select("item_id", "conv_id", "turn")


TOKENS = f"t AS (SELECT item_id, {WORDS} AS w FROM benchmark), k AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t)"


@query("content_deletion", "WITH " + TOKENS + """, e AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sha256(concat_ws(chr(31), '11', item_id::VARCHAR, i::VARCHAR))[1:16], i) AS place,
  count(*) OVER (PARTITION BY item_id) AS n FROM k WHERE regexp_matches(word, '^[A-Za-z]{3,}$')),
m AS (SELECT k.item_id, k.i, d.dose, CASE WHEN place <= floor(n * d.dose + 0.5) THEN '___' ELSE word END AS word FROM (SELECT k.*, e.place, e.n FROM k LEFT JOIN e USING (item_id, i)) k, (VALUES (0.1::DOUBLE), (0.25), (0.5)) d(dose))
SELECT item_id, dose, string_agg(word, ' ' ORDER BY i) AS text, count(*) FILTER (word = '___') AS n_deleted FROM m GROUP BY ALL""")  # fmt: skip
def content_deletion(spark, sf_dir):
    """Items with a tenth, a quarter and half of their eligible words blanked, nested."""
    b = table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    versions = F.array(*[F.struct(F.lit(d).alias("dose"), text.blank_words(F.col("w"), F.col("item_id").cast("string"), d, "11").alias("w")) for d in (0.1, 0.25, 0.5)])
    rows = b.select("item_id", F.explode(versions).alias("v"))
    return rows.select("item_id", "v.dose", F.array_join("v.w", " ").alias("text"), F.size(F.filter("v.w", lambda w: w == "___")).cast("long").alias("n_deleted"))


#: A parameter: words that no deletion blanks.
STOPWORDS = ["the", "and", "that", "this", "with", "for", "den", "die", "les", "des", "los", "las"]
PIECES = r"regexp_extract_all(text, '(?is)[A-Za-z'']*?(?:https?://\S+|www\.\S+)|[A-Za-z]+(?:''[A-Za-z]+)?|[^A-Za-z]')"


@query("content_deletion_tracks", f"""WITH b AS (SELECT item_id, text || ' See www.example.org/abc, or xhttp://a.b the And.' AS text FROM benchmark), p AS (SELECT item_id, unnest({PIECES}) AS w, generate_subscripts({PIECES}, 1) AS i FROM b),
f AS (SELECT *, regexp_full_match(w, '[A-Za-z]+(?:''[A-Za-z]+)?') AND length(replace(w, '''', '')) >= 3 AND lower(w) NOT IN ({", ".join(repr(w) for w in STOPWORDS)}) AS ok FROM p),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id, ok ORDER BY i) - 1 AS k, count(*) FILTER (ok) OVER (PARTITION BY item_id) AS n FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY item_id, track, ok ORDER BY sha256(concat_ws(chr(31), '31', item_id::VARCHAR, track::VARCHAR, k::VARCHAR, lower(w)))[1:16], k) AS place FROM g, range(3) t(track))
SELECT item_id, track::INTEGER AS track, dose, sha256(string_agg(CASE WHEN ok AND place <= floor(n * dose + 0.5) THEN '___' ELSE w END, '' ORDER BY i)) AS text_sha256, any_value(n)::INTEGER AS n_eligible, floor(any_value(n) * dose + 0.5)::INTEGER AS n_deleted FROM h, (VALUES (0.1::DOUBLE), (0.25), (0.5)) d(dose) GROUP BY item_id, track, dose""")  # fmt: skip
def content_deletion_tracks(spark, sf_dir):
    """Items under three tracks of deletions, each nested over three doses: words are blanked in place, stopwords and addresses stay."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit(" See www.example.org/abc, or xhttp://a.b the And.")).alias("text"))
    b = b.withColumn("track", F.explode(F.sequence(F.lit(0), F.lit(2))))

    def version(dose: float):
        out, n, k = text.delete_words(F.col("text"), F.col("item_id").cast("string"), F.col("track").cast("string"), dose, "31", STOPWORDS)
        return F.struct(F.lit(dose).alias("dose"), F.sha2(out, 256).alias("text_sha256"), n.alias("n_eligible"), k.alias("n_deleted"))

    return b.select("item_id", "track", F.explode(F.array(*[version(d) for d in (0.1, 0.25, 0.5)])).alias("v")).select("item_id", "track", "v.*")


@query("nested_dose_check", "WITH " + TOKENS + """, e AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sha256(concat_ws(chr(31), '11', item_id::VARCHAR, i::VARCHAR))[1:16], i) AS place,
  count(*) OVER (PARTITION BY item_id) AS n FROM k WHERE regexp_matches(word, '^[A-Za-z]{3,}$'))
SELECT item_id, count(*) FILTER (place <= floor(n * 0.25 + 0.5) AND place > floor(n * 0.5 + 0.5)) AS n_not_nested, max(n) AS n_eligible FROM e GROUP BY item_id""")  # fmt: skip
def nested_dose_check(spark, sf_dir):
    """Blanks of the smaller dose that the larger lacks: none."""
    b = table(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("w")).where(F.size(F.filter(text.words(F.col("text")), text.eligible)) > 0)
    key = F.col("item_id").cast("string")
    low, high = (text.blank_words(F.col("w"), key, d, "11") for d in (0.25, 0.5))
    lost = F.filter(F.zip_with(low, high, lambda a, c: (a == "___") & (c != "___")), lambda x: x)
    return b.select("item_id", F.size(lost).cast("long").alias("n_not_nested"), F.size(F.filter("w", text.eligible)).cast("long").alias("n_eligible"))


@query("word_masking", f"""WITH t AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations), k AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sha256(concat_ws(chr(31), '3', conv_id || ':' || turn, i::VARCHAR))[1:16], i) AS place, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM k)
SELECT conv_id, turn, string_agg(CASE WHEN place <= floor(n * 0.3) THEN '[MASK]' ELSE word END, ' ' ORDER BY i) AS masked FROM e GROUP BY ALL""")  # fmt: skip
def word_masking(spark, sf_dir):
    """floor(0.3 n) words of each turn masked, in hash order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    key = F.concat_ws(":", "conv_id", "turn")
    masked = text.mark_first(F.col("w"), lambda w, i: hashing.stable_key("3", key, i.cast("string")), F.floor(F.size("w") * 0.3).cast("int"), "[MASK]")
    return c.select("conv_id", "turn", F.array_join(masked, " ").alias("masked"))


def eligible_sources(spark, sf_dir):
    """item_id, source, n_words: every item of another category that doesn't hold the item's text, blocks of items by blocks of sources."""
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 4).alias("category"), text.fold(F.col("text")).alias("f"), F.size(text.words(F.col("text"))).alias("n_words"))
    b = b.crossJoin(F.broadcast(b.agg(F.count("*").alias("n_rows"))))
    x = b.select("item_id", "category", F.col("f").alias("needle"), "n_rows")
    y = b.select(F.col("item_id").alias("source"), F.col("category").alias("c2"), F.col("f").alias("hay"), "n_words", "n_rows")
    held = F.coalesce((F.length("needle") > 0) & F.contains("hay", "needle"), F.lit(False))
    return block_join(x, y, [], "item_id", "source").where((F.col("category") != F.col("c2")) & ~held).select("item_id", "source", "n_words")


INJECT = f"""b AS (SELECT item_id, item_id % 4 AS category, {WORDS} AS w, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS f FROM benchmark),
c AS (SELECT x.item_id, y.item_id AS source, y.w, row_number() OVER (PARTITION BY x.item_id ORDER BY sha256(concat_ws(chr(31), '5', x.item_id::VARCHAR, y.item_id::VARCHAR))[1:16], y.item_id) AS place
  FROM b x JOIN b y ON x.category <> y.category AND len(y.w) > 0 AND NOT coalesce(length(x.f) > 0 AND contains(y.f, x.f), false)),
u AS (SELECT *, sum(len(w)) OVER (PARTITION BY item_id ORDER BY place) AS upto FROM c)"""  # fmt: skip
LARGEST = 64


def ranked_sources(spark, sf_dir):
    """item_id, source, place, span_start, upto: of all eligible sources in hash order, those that fill the largest dose."""
    c = eligible_sources(spark, sf_dir).where("n_words > 0")
    down = Window.partitionBy("item_id").orderBy(hashing.stable_key("5", F.col("item_id").cast("string"), F.col("source").cast("string")), "source")
    c = c.withColumn("place", F.row_number().over(down)).withColumn("upto", F.sum("n_words").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return c.withColumn("span_start", F.col("upto") - F.col("n_words")).where(F.col("span_start") < LARGEST).select("item_id", "source", "place", "span_start", "upto")


def filled(n_words, value):
    """``value``; an item whose sources don't fill the largest dose is an error."""
    return F.when(F.coalesce(n_words, F.lit(0)) < LARGEST, F.raise_error(F.concat(F.lit("too few context words for item "), F.col("item_id").cast("string")))).otherwise(value)


@query("context_injection", "WITH " + INJECT + """, f AS (SELECT item_id, flatten(list(w ORDER BY place)) AS w FROM u GROUP BY item_id)
SELECT f.item_id, d.dose::INTEGER AS dose, array_to_string(f.w[1:d.dose], ' ') || chr(10) || chr(10) || benchmark.text AS text FROM f JOIN benchmark USING (item_id), (VALUES (16), (64)) d(dose)""")  # fmt: skip
def context_injection(spark, sf_dir):
    """Words of all eligible sources in hash order, cut to nested budgets, before every item."""
    b = table(spark, sf_dir, "benchmark")
    c = ranked_sources(spark, sf_dir).join(b.select(F.col("item_id").alias("source"), text.words(F.col("text")).alias("w")), "source")
    f = c.groupBy("item_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "w"))), lambda s: s["w"])).alias("w"))  # 64 lists at most
    f = b.join(f, "item_id", "left").withColumn("dose", F.explode(F.array(F.lit(16), F.lit(LARGEST))))
    return f.select("item_id", "dose", filled(F.size("w"), F.concat(F.array_join(F.slice("w", F.lit(1), F.col("dose")), " "), F.lit("\n\n"), "text")).alias("text"))


@query("source_spans", "WITH " + INJECT + """ SELECT item_id, source, place::INTEGER AS place, (upto - len(w))::BIGINT AS span_start, least(upto, 64)::BIGINT AS span_end FROM u WHERE upto - len(w) < 64""")
def source_spans(spark, sf_dir):
    """Which words of the context come from which source, of all eligible ones."""
    c = ranked_sources(spark, sf_dir).withColumn("n", F.max("upto").over(Window.partitionBy("item_id")))
    c = table(spark, sf_dir, "benchmark").select("item_id").join(c, "item_id", "left")
    return c.select("item_id", "source", filled(F.col("n"), F.col("place")).alias("place"), F.col("span_start").cast("long").alias("span_start"), F.least("upto", F.lit(LARGEST)).cast("long").alias("span_end"))


@query("prompt_manifest", """WITH o AS (SELECT item_id, text, [item_id::VARCHAR, (item_id + 1)::VARCHAR, (item_id * 2)::VARCHAR, '7'] AS o FROM benchmark),
p AS (SELECT item_id, r::INTEGER AS rotation, text || chr(10) || 'A. ' || o[((0 + r) % 4 + 1)::INTEGER] || chr(10) || 'B. ' || o[((1 + r) % 4 + 1)::INTEGER] || chr(10) || 'C. ' || o[((2 + r) % 4 + 1)::INTEGER] || chr(10) || 'D. ' || o[((3 + r) % 4 + 1)::INTEGER] || chr(10) || 'Answer with one letter.' AS prompt FROM o, range(4) q(r))
SELECT item_id, rotation, sha256(concat_ws(chr(31), item_id::VARCHAR, rotation::VARCHAR))[1:16] AS prompt_id, sha256(prompt) AS prompt_sha256, ((4 - rotation) % 4)::INTEGER AS gold_visible FROM p""")  # fmt: skip
def prompt_manifest(spark, sf_dir):
    """Every item in four cyclic rotations of its options, with stable ids and digests."""
    b = table(spark, sf_dir, "benchmark")
    options = F.array(F.col("item_id").cast("string"), (F.col("item_id") + 1).cast("string"), (F.col("item_id") * 2).cast("string"), F.lit("7"))
    rows = b.withColumn("rotation", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("o", options)
    shown = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get("o", (i + F.col("rotation")) % 4))
    return rows.select("item_id", "rotation", hashing.stable_key(F.col("item_id").cast("string"), F.col("rotation").cast("string")).alias("prompt_id"), F.sha2(text.prompt(F.col("text"), shown), 256).alias("prompt_sha256"), ((4 - F.col("rotation")) % 4).cast("int").alias("gold_visible"))


LABELLED = "q AS (SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN ' Final answer: ' || 'ABCD'[turn % 4 + 1] || '.' WHEN 1 THEN ' so (' || 'ABCDEFG'[turn % 7 + 1] || ')' WHEN 2 THEN ' answer is c' ELSE '' END AS text FROM conversations)"


def labelled(spark, sf_dir):
    tail = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit(" Final answer: "), F.substring(F.lit("ABCD"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1)), F.lit("."))).when(F.col("conv_id") % 4 == 1, F.concat(F.lit(" so ("), F.substring(F.lit("ABCDEFG"), (F.col("turn") % 7 + 1).cast("int"), F.lit(1)), F.lit(")"))).when(F.col("conv_id") % 4 == 2, " answer is c").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("text"))


@query("label_extraction", "WITH " + LABELLED + r""",
x AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text[-4096:], '(?is)answer\s*(?:is|:)?\s*\(?([A-J])\)?', 1), lambda c: upper(c)), lambda c: contains('ABCD', c)) AS e,
  list_filter(list_transform(regexp_extract_all(regexp_replace(text[-4096:], '([^A-Za-z0-9])', '\1\1', 'g'), '(?i)(?:^|[^A-Za-z0-9])\(?([A-J])\)?(?:[^A-Za-z0-9]|$)', 1), lambda c: upper(c)), lambda c: contains('ABCD', c)) AS l, list_filter(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-J])(?:[^A-Za-z]|$)', 1), lambda c: contains('ABCD', c)) AS f FROM q)
SELECT conv_id, turn, coalesce(e[-1], l[-1]) AS final_label, CASE WHEN len(e) > 0 THEN 'explicit_final_answer' WHEN len(l) > 0 THEN 'final_standalone_label' ELSE 'unresolved' END AS method, f[1] AS first_label FROM x""")  # fmt: skip
def label_extraction(spark, sf_dir):
    """Final and first option letters of turns to which answers were appended."""
    label, method = text.final_label(F.col("text"), 4)
    return labelled(spark, sf_dir).select("conv_id", "turn", label.alias("final_label"), method.alias("method"), text.first_label(F.col("text"), 4).alias("first_label"))


@query("generation_agreement", "WITH " + LABELLED + r""",
x AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-J])(?:[^A-Za-z]|$)', 1), lambda c: contains('ABCD', c))[1] AS f FROM q)
SELECT conv_id % 10 AS grp, count(*) AS n, round(avg((f IS NULL)::INTEGER), 9) AS malformed, round(avg(coalesce(f = 'ABCD'[turn % 4 + 1], false)::INTEGER), 9) AS agreement, round(avg((f = 'ABCD'[turn % 4 + 1])::INTEGER) FILTER (f IS NOT NULL), 9) AS agreement_valid FROM x GROUP BY ALL""")  # fmt: skip
def generation_agreement(spark, sf_dir):
    x = labelled(spark, sf_dir).select("conv_id", text.first_label(F.col("text"), 4).alias("f"), F.substring(F.lit("ABCD"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1)).alias("g"))
    same = F.coalesce(F.col("f") == F.col("g"), F.lit(False)).cast("int")
    return x.groupBy((F.col("conv_id") % 10).alias("grp")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("f").isNull().cast("int")), 9).alias("malformed"), F.round(F.avg(same), 9).alias("agreement"), F.round(F.avg((F.col("f") == F.col("g")).cast("int")), 9).alias("agreement_valid"))


TFIDF = f"""WITH b AS (SELECT item_id, unnest({WORDS}) AS w FROM benchmark), tf AS (SELECT item_id, lower(w) AS w, count(*) AS tf FROM b GROUP BY ALL),
df AS (SELECT w, ln((1 + (SELECT count(DISTINCT item_id) FROM b)) / (1 + count(*))) + 1 AS idf, count(*) AS df FROM tf GROUP BY w),
v AS (SELECT item_id, w, tf * idf AS v, df FROM tf JOIN df USING (w)), n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM v GROUP BY item_id),
s AS (SELECT l.item_id AS a, r.item_id AS b, sum(l.v * r.v) AS s FROM v l JOIN v r USING (w) WHERE l.item_id < r.item_id GROUP BY ALL)
SELECT a, b, round(s / (x.n * y.n), 6) AS similarity FROM s JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b"""  # fmt: skip


@query("tfidf_similarity", TFIDF)
def tfidf_similarity(spark, sf_dir):
    """Cosine of every two items that share a term, over all terms; a term of many items is dealt into cells of bounded size."""
    v = term_weights(spark, sf_dir)
    return cosines(v, block_join(term_side(v, "a", "va", "df"), term_side(v, "b", "vb", "df"), ["w"], "a", "b", n="df"))


def term_weights(spark, sf_dir):
    """item_id, w, v, df: TF-IDF of each item's terms and how many items a term is in."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.words(F.col("text"))).alias("w"))
    tf = b.groupBy("item_id", F.lower("w").alias("w")).agg(F.count("*").alias("tf"))
    n_items = b.agg(F.countDistinct("item_id").alias("n_items"))
    df = tf.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n_items)).select("w", "df", (F.log((1 + F.col("n_items")) / (1 + F.col("df"))) + 1).alias("idf"))
    return tf.join(df, "w").select("item_id", "w", (F.col("tf") * F.col("idf")).alias("v"), "df")


def term_side(v, item, value, *more):
    return v.select(F.col("item_id").alias(item), "w", F.col("v").alias(value), *more)


def cosines(v, pairs):
    norm = v.groupBy("item_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    s = pairs.where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("s"))
    s = s.join(norm.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a").join(norm.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
    return s.select("a", "b", F.round(F.col("s") / (F.col("na") * F.col("nb")), 6).alias("similarity"))


#: Of an item's eligible sources so many at least, or a quarter, are those of low similarity.
LOW = 20


def _track_sql(k: int) -> str:
    """Sources of one track: those that earlier tracks used come last."""
    used = " OR ".join(f"(item_id, source) IN (SELECT item_id, source FROM t{j})" for j in range(k)) or "false"
    return f"""p{k} AS (SELECT item_id, source, n, row_number() OVER (PARTITION BY item_id ORDER BY ({used})::INTEGER, sha256(concat_ws(chr(31), '6', item_id::VARCHAR, '{k}', source::VARCHAR))[1:16], source) AS place FROM low),
t{k} AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY item_id ORDER BY place) AS upto FROM p{k}) WHERE upto - n < 64)"""


@query("context_tracks", TFIDF.replace("WITH b AS", "WITH tb AS").replace("FROM b)", "FROM tb)").replace("FROM b GROUP", "FROM tb GROUP").replace("SELECT a, b, round", ", sim AS (SELECT a, b, round") + "), " + INJECT.split("c AS (SELECT x.item_id")[0] + f"""
el AS (SELECT x.item_id, y.item_id AS source, len(y.w) AS n, row_number() OVER (PARTITION BY x.item_id ORDER BY coalesce(sim.similarity, 0), y.item_id) AS place, count(*) OVER (PARTITION BY x.item_id) AS many
  FROM b x JOIN b y ON x.category <> y.category AND len(y.w) > 0 AND NOT coalesce(length(x.f) > 0 AND contains(y.f, x.f), false) LEFT JOIN sim ON sim.a = least(x.item_id, y.item_id) AND sim.b = greatest(x.item_id, y.item_id)),
low AS (SELECT item_id, source, n FROM el WHERE place <= greatest({LOW}, ceil(0.25 * many))), """ + ", ".join(_track_sql(k) for k in range(3)) + " " + " UNION ALL ".join(f"SELECT {k} AS track, item_id, source, place::INTEGER AS place, (upto - n)::BIGINT AS span_start FROM t{k}" for k in range(3)))  # fmt: skip
def context_tracks(spark, sf_dir):
    """Three contexts of each item from its eligible sources of low similarity, each in a hash order of its own; what an earlier context used comes last."""
    sim = tfidf_similarity(spark, sf_dir)
    both = sim.select(F.col("a").alias("item_id"), F.col("b").alias("source"), "similarity").unionByName(sim.select(F.col("b").alias("item_id"), F.col("a").alias("source"), "similarity"))
    el = eligible_sources(spark, sf_dir).where("n_words > 0").join(both, ["item_id", "source"], "left")
    w = Window.partitionBy("item_id")
    el = el.withColumn("rank", F.row_number().over(w.orderBy(F.coalesce("similarity", F.lit(0.0)), "source"))).withColumn("many", F.count("*").over(w))
    low = staged(spark, ("low_sources", sf_dir), lambda: el.where(F.col("rank") <= F.greatest(F.lit(LOW), F.ceil(0.25 * F.col("many")))).select("item_id", "source", "n_words"))
    used, out = None, None
    for track in range(3):
        rows = low.withColumn("used", F.lit(0)) if used is None else low.join(used.withColumn("used", F.lit(1)), ["item_id", "source"], "left").fillna(0, ["used"])
        down = w.orderBy("used", hashing.stable_key("6", F.col("item_id").cast("string"), str(track), F.col("source").cast("string")), "source")
        rows = rows.withColumn("place", F.row_number().over(down)).withColumn("span_start", F.sum("n_words").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_words")).where(F.col("span_start") < LARGEST)
        own = rows.select(F.lit(track).alias("track"), "item_id", "source", "place", F.col("span_start").cast("long").alias("span_start"))
        own = staged(spark, ("context_track", track, sf_dir), lambda own=own: own)
        named = own.select("item_id", "source")
        used, out = (named, own) if out is None else (used.unionByName(named).distinct(), out.unionByName(own))
    return out
