"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_index import token_output

    return token_output(spark, _read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(spark, _read(spark, sf_dir, "pages"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lm_score import lm_scores

    return lm_scores(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_report

    return mix_report(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_report

    return fingerprint_report(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_read(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    return contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_warc": op2_warc,
    "op3_lm_score": op3_lm_score,
    "op4_mixing": op4_mixing,
    "op5_near_dup": op5_near_dup,
    "op6_token_counts": op6_token_counts,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_decontamination": op10_decontamination,
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
with p as (select page_id, encode(coalesce(html, '')) b from pages), q as (select page_id, octet_length(b) n, sha1(b) d from p), r as (select *, max(page_id) over (partition by d) top from q)
select page_id, n::bigint payload_bytes, d payload_digest, case when n >= 1000 and page_id < top then 'revisit' else 'response' end record_type, case when n >= 1000 and page_id < top then top end refers_to from r""",
    "op5_near_dup": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) g from w),
n as (select doc_id, count(*) n from s group by 1),
links as (select x.a, x.b from (select a.doc_id a, b.doc_id b, count(*) m from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2) x join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b where 100 * m >= 80 * (na.n + nb.n - m)),
reach as (select doc_id d, doc_id r from documents union select d, b from reach join links on a = r)
select documents.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id, documents.doc_id = component_id kept from documents left join n using (doc_id) join (select d doc_id, min(r) component_id from reach group by 1) using (doc_id)""",
    "op10_decontamination": rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
i as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, w[k:k+9] g from i, unnest(generate_series(1, greatest(1, len(w) - 9))) t(k) where len(w) > 0),
occ as (select doc_id, k, n, item_id from (select doc_id, n, k, w[k:k+n-1] g from d, (select distinct len(g) n from win), unnest(generate_series(1, len(w) - n + 1)) t(k)) join win using (g)),
hits as (select doc_id, count(distinct k + j) n_hit from occ, unnest(generate_series(0, n - 1)) t(j) group by 1),
items as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) names from (select distinct doc_id, item_id::varchar x from occ) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join hits using (doc_id) left join items using (doc_id)""",
}
