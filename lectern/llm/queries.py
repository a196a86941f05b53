"""The queries of the operators for training data, and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import forest, leakage, neighbours, oversized, quality, sentences, termfreq, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


_HEAVY = ("documents", "papers", "parsed_papers", "passages", "passage_vectors")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name, heavy=name in _HEAVY)


def _titles(spark: SparkSession, sf_dir: str, complete: bool) -> forest.Found:
    return forest.near_duplicates(_table(spark, sf_dir, "papers"), "clean_id", "title", run=1, least=0.6, least_set=4, complete=complete)


def _contents(spark: SparkSession, sf_dir: str, complete: bool) -> forest.Found:
    return forest.near_duplicates(_table(spark, sf_dir, "passages").where("type = 'text'"), "passage_id", "content", run=3, least=0.5, least_words=40, complete=complete)


def _both(spark: SparkSession, sf_dir: str, complete: bool) -> tuple[forest.Found, forest.Found]:
    """Titles and contents, whose jobs don't depend on each other, side by side."""
    with ThreadPoolExecutor(2) as pool:
        title, content = pool.submit(_titles, spark, sf_dir, complete), pool.submit(_contents, spark, sf_dir, complete)
        return title.result(), content.result()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, content = (forest.record_pairs(x) for x in _both(spark, sf_dir, True))
    rows = title.withColumn("field", F.lit("title")).unionByName(content.withColumn("field", F.lit("content")))
    return rows.select("field", "key_a", "key_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, content = (forest.groups(x) for x in _both(spark, sf_dir, False))
    rows = title.withColumn("field", F.lit("title")).unionByName(content.withColumn("field", F.lit("content")))
    return rows.select("field", "key", "class_id", "group_id", "links")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = oversized.block_items(_table(spark, sf_dir, "parsed_papers"))
    return oversized.split_oversized(blocks.unionByName(oversized.passage_items(_table(spark, sf_dir, "passages"))))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized.oversized_items(p2_pieces(spark, sf_dir))


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termfreq.term_statistics(_table(spark, sf_dir, "passages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "passage_vectors"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(p4_nearest(spark, sf_dir), vectors=spark.read.parquet(f"{sf_dir}/passage_vectors.parquet"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _table(spark, sf_dir, "passages").where((F.col("type") == "text") & F.col("content").isNotNull())
    return sentences.sentence_rows(passages).withColumn("end_pos", F.col("end_pos").cast("int"))


def p5_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by chunks so small that most texts have several."""
    passages = _table(spark, sf_dir, "passages").where((F.col("type") == "text") & F.col("content").isNotNull())
    return sentences.sentence_rows(passages, chunk=300).withColumn("end_pos", F.col("end_pos").cast("int"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_corpus(_table(spark, sf_dir, "documents"))


def p6_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by chunks so small that most texts are several stretches."""
    return tokenizer.encode_corpus(_table(spark, sf_dir, "documents"), chunk=50, overlap=20, chunks=4)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_shares(spark, sf_dir).select("doc_id", "item_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_statistics(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "common_words"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_statistics(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_terms, p4_found, p4_nearest, p5_found, p5_chunked, p6_ids, p6_chunked, p7_found, p7_shares, p8_found, p8_statistics)}


_TERMS = " union all ".join(
    f"""select '{f}' field, term, count(*)::bigint occurrences, count(distinct passage_id)::bigint passages,
    (select count(distinct passage_id) from passages where {f} is not null) n
    from (select passage_id, unnest(regexp_extract_all(lower(nfc_normalize({f})), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) term
          from (select distinct passage_id, {f} from passages where passage_id is not null)) group by term"""
    for f in ("content", "contextual_content")
)
_MARK = "case when passages < 3 then 'rare' when passages > 0.25 * n then 'common' end"
_WORDS = "regexp_extract_all(lower(nfc_normalize({0})), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')"
#: Sets of words of titles and of runs of three words of text passages, and the pairs of keys with enough in common.
_SETS = f"""title as (select clean_id k, list_distinct({_WORDS.format('title')}) s from (select distinct clean_id, title from papers where clean_id is not null and title is not null)),
    txt as (select passage_id k, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s
        from (select passage_id, {_WORDS.format('content')} w from (select distinct passage_id, content from passages where type = 'text' and content is not null and passage_id is not null)
              where len(list_filter(regexp_split_to_array(content, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda x: x <> '')) >= 40)),
    sets as (select 'title' f, k, row_number() over () r, s, len(s) n, 0.6 least from title where len(s) >= 4 union all select 'content', k, row_number() over (), s, len(s), 0.5 from txt where len(s) > 0),
    flat as (select f, k, r, n, least, unnest(s) x from sets)"""
_PAIRS = f"""with {_SETS} select distinct f field, least(a, b) key_a, greatest(a, b) key_b from (
    select p.f, p.k a, q.k b, p.n + q.n - count(*) u, count(*) c, any_value(p.least) least from flat p join flat q on p.f = q.f and p.x = q.x and p.r < q.r and p.k <> q.k group by p.f, p.k, q.k, p.r, q.r, p.n, q.n) where c >= least * u"""
_GOOD = """(select distinct on (vec_id) vec_id, embedding::double[] e from passage_vectors where vec_id is not null and len(embedding) = 96 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and list_max(embedding) - list_min(embedding) + abs(embedding[1]) > 0)"""
_NEAR = f"""select distinct least(a, b) vec_a, greatest(a, b) vec_b from (select a, b, c, row_number() over (partition by a order by c desc, b) r from (
    select p.vec_id a, q.vec_id b, list_cosine_similarity(p.e, q.e) c from {_GOOD} p, {_GOOD} q where p.vec_id <> q.vec_id)) where r <= 5 and c >= 0.85"""
_SPLIT = "regexp_extract_all(regexp_replace(lower(text), '([\\p{Han}\\p{Hiragana}\\p{Katakana}])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+')"
_EIGHT = "list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))"
_LEAKS = f"""with i as (select item_id, w, {_EIGHT} g from (select item_id, {_SPLIT} w from eval_items where text is not null)),
    ig as (select item_id, len(w) n, unnest(g) g, unnest(range(1, len(g) + 1)) p from i),
    d as (select distinct doc_id, unnest({_EIGHT}) g from (select doc_id, {_SPLIT} w from documents where text is not null)),
    hit as (select distinct doc_id, item_id, n, unnest(range(p, p + 8)) place from d join ig using (g))
    select doc_id, item_id from hit group by doc_id, item_id, n having count(*) >= 0.5 * n"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _PAIRS,
        "p3_terms": f"select field, term, occurrences, passages, {_MARK} mark from ({_TERMS})",
        "p3_found": f"select field, term, {_MARK} mark from ({_TERMS}) where {_MARK} is not null",
        "p4_found": _NEAR,
        "p7_found": _LEAKS,
    }
