"""Queries on texts, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encode as E

QUERIES, SQL = {}, {}


def query(sql: str | None, table: str = "documents"):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'http[^\n]+(\n|$)|http$', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), '#[0-9A-Za-z_]+', '', 'g'), '@[0-9A-Za-z_]+', '', 'g'), '[^0-9A-Za-z \t]', ' ', 'g'), '[ \t]+', ' ', 'g'))"""
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = f"list_filter(string_split(lower({_CLEAN}), ' '), lambda x: x <> '')"


@query(f"select doc_id, {_CLEAN} as cleaned from documents")
def clean_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(f"select doc_id, array_to_string(list_filter({_TOKENS}, lambda x: x not in ({_STOP})), ' ') as tokens from documents")
def tokens_no_stopwords(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_join(T.preprocess(F.col("text")), " ").alias("tokens"))


@query(f"select doc_id, array_to_string(list_sort(list_distinct(list_filter({_TOKENS}, lambda x: x not in ({_STOP})))), ' ') as tokens from documents")
def preprocess_unique(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_join(T.preprocess(F.col("text"), unique=True), " ").alias("tokens"))


@query(f"with t as (select unnest({_TOKENS}) as token from documents) select token, count(*) as n, round(count(*) / (select count(*) from documents), 6) as pct from t group by 1")
def token_counts_pct(docs: DataFrame) -> DataFrame:
    words = docs.select(F.explode(T.preprocess(F.col("text"), stop_words=False)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return words.withColumn("pct", F.round(F.col("n") / F.lit(docs.count()), 6))


@query(r"""with w as (select doc_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+')) as w from documents)
select doc_id, count(*) filter (w[1] = '#') as hashtags, count(*) filter (w[1] = '@') as mentions, coalesce(string_agg(trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~'), ' ' order by trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')) filter (w[1] = '#' or w[1] = '@'), '') as named from w group by 1""")
def entities_prefix(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", T.entities(F.col("text"), "#").alias("h"), T.entities(F.col("text"), "@").alias("m"))
    return rows.select("doc_id", F.size("h").cast("long").alias("hashtags"), F.size("m").cast("long").alias("mentions"), F.array_join(F.array_sort(F.concat("h", "m")), " ").alias("named"))


@query(f"""with t as (select doc_id, unnest({_TOKENS}) as token, unnest(range(0, len({_TOKENS}))) as pos from documents)
select token, count(*) as occurrences, row_number() over (order by min(doc_id * 4294967296 + pos), token) - 1 as idx from t group by 1""")
def vocabulary_index(docs: DataFrame) -> DataFrame:
    words = docs.select("doc_id", F.posexplode(T.preprocess(F.col("text"), stop_words=False)).alias("pos", "token"))
    return E.vocabulary(words.withColumn("seq", F.col("doc_id") * (1 << 32) + F.col("pos")), "token", "seq")


@query(f"""with t as (select doc_id, unnest({_TOKENS}) as token, unnest(range(0, len({_TOKENS}))) as pos from documents),
v as (select token, row_number() over (order by min(doc_id * 4294967296 + pos), token) - 1 as idx from t group by 1)
select doc_id, string_agg(cast(idx as varchar), ' ' order by pos) as indices from t join v using (token) group by 1""")
def token_indices(docs: DataFrame) -> DataFrame:
    return E.token_lists(docs, "doc_id", T.preprocess(F.col("text"), stop_words=False)).withColumnRenamed("id", "doc_id")


@query(f"""with t as (select doc_id, unnest({_TOKENS}) as token, unnest(range(0, len({_TOKENS}))) as pos from documents),
v as (select token, min(doc_id * 4294967296 + pos) as first from t where length(token) between 4 and 6 and token not in ({_STOP}) group by 1),
i as (select token, row_number() over (order by first, token) - 1 as idx from v)
select doc_id, count(*) as n, cast(sum(idx) as bigint) as idx_sum, round(sum(length(token) / 10.0), 6) as vec_sum from t join i using (token) group by 1""")
def embedded_tokens(docs: DataFrame) -> DataFrame:
    """Tokens with the vectors of a table of words (those of four to six letters) and their numbers."""
    words = docs.select(F.explode(F.array_distinct(T.preprocess(F.col("text")))).alias("word")).distinct()
    vectors = words.where(F.length("word").between(4, 6)).select("word", F.array(F.length("word") / F.lit(10.0), F.lit(1.0)).alias("vec"))
    rows = E.embedded_tokens(docs, "doc_id", T.preprocess(F.col("text")), vectors)
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum("idx").alias("idx_sum"), F.round(F.sum(F.col("vec")[0]), 6).alias("vec_sum"))


@query("select doc_id from documents where cast('0x' || substr(md5('7:' || cast(doc_id as varchar)), 1, 8) as bigint) < 858993459")
def fraction_sample(docs: DataFrame) -> DataFrame:
    return E.fraction_sample(docs, "doc_id", 0.2, 7).select("doc_id")


@query("select source, '@' || source || ' OR from:' || source || ' OR to:' || source as q, replace(replace(replace('@' || source || ' OR from:' || source, '@', '%40'), ' ', '+'), ':', '%3A') as encoded from (select distinct source from documents)")
def query_strings(docs: DataFrame) -> DataFrame:
    rows = docs.select("source").distinct()
    return rows.select("source", T.handle_query(F.col("source")).alias("q"), F.url_encode(F.concat(F.lit("@"), "source", F.lit(" OR from:"), "source")).alias("encoded"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(json_extract_string(props, '$.missing.deep'), 'none') as deep from events", "events")
def nested_get(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing.deep"), F.lit("none")).alias("deep"))


@query("""with w as (select doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) as words from documents)
select doc_id, list_contains(words, 'the') as has_the, list_has_any(words, ['von', 'que', 'les']) as has_any, len(words) > 50 as many, len(list_filter(words, lambda x: x in ('the', 'and', 'of'))) as kept from w""")
def array_filters(docs: DataFrame) -> DataFrame:
    words = F.array_distinct(F.array_remove(F.split(F.lower("text"), " "), ""))
    rows = docs.select("doc_id", words.alias("words"))
    included = F.filter("words", lambda w: F.array_contains(F.split(F.lit("the,and,of"), ","), w))
    return rows.select("doc_id", F.array_contains("words", "the").alias("has_the"), F.arrays_overlap("words", F.array(F.lit("von"), F.lit("que"), F.lit("les"))).alias("has_any"),
                       (F.size("words") > 50).alias("many"), F.size(included).cast("long").alias("kept"))


@query("select doc_id, 'RT ' || regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g') as text, len(list_concat(string_split(text, ' '), [source, lang])) as flat from documents")
def prefix_and_flatten(docs: DataFrame) -> DataFrame:
    flat = F.flatten(F.array(F.split("text", " "), F.array("source", "lang")))
    return docs.select("doc_id", F.concat(F.lit("RT "), F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("text"), F.size(flat).cast("long").alias("flat"))


@query(None)
def porter_stem(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_join(T.preprocess(F.col("text"), stem=True, unique=True), " ").alias("stems"))


_LEMMAS = {"thes": "the", "ands": "and", "ofs": "of", "was": "be", "are": "be", "is": "be"}


@query(f"""with l as (select unnest({list(_LEMMAS)}) as w, unnest({list(_LEMMAS.values())}) as lemma), t as (select doc_id, unnest({_TOKENS}) as token, unnest(range(0, len({_TOKENS}))) as pos from documents)
select d.doc_id, coalesce(x.lemmas, '') as lemmas from documents d left join (select doc_id, string_agg(coalesce(lemma, token), ' ' order by pos) as lemmas from t left join l on token = w group by 1) x using (doc_id)""")
def dictionary_lemmas(docs: DataFrame) -> DataFrame:
    """Lemmas from a dictionary, a literal map that Spark looks words up in."""
    words = T.lemmatised(T.preprocess(F.col("text"), stop_words=False), _LEMMAS)
    return docs.select("doc_id", F.array_join(words, " ").alias("lemmas"))


def _suffix_tags(words: list[str]) -> list[str]:
    return ["V" if w.endswith(("ing", "ed", "er", "en")) else "N" for w in words]


@query(None)
def part_of_speech_gate(docs: DataFrame) -> DataFrame:
    kept = T.preprocess(F.col("text"), tagger=_suffix_tags, lemmatise=lambda w: w[:-1] if w.endswith("s") and not w.endswith("ss") else w)
    return docs.select("doc_id", F.size(kept).cast("long").alias("n_tokens"))
