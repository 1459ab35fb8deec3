"""The queries of this subpackage's operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltstone.llm import bpe, dartminhash, decontam, langid, licences, lines, mixing, ogg, suffix, tokencounts, vectorcodes, warc, whitening
from siltstone.llm.shared import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.label_documents(docs, licences.fit(docs))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), weight="count").select("doc_id", "class_id", "n_shingles")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("text", 256).alias("kept_sha256"))


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_features(ogg.store_documents(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.section_counts(table(spark, sf_dir, "documents"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages")))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_benchmark_decontamination, op2_suffix_array_dedup, op3_license_scan, op4_language_id, op5_minhash_near_dedup, op6_line_dedup, op7_bpe_encoding, op8_media_columns, op9_token_counts, op10_warc_archive, op11_vector_codes, op12_embedding_whitening, op13_source_mix)}


def oracle_sql() -> dict[str, str]:
    return {"op10_warc_archive": WARC_SQL, "op11_vector_codes": codes_sql(), "op13_source_mix": MIX_SQL}


WARC_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), d as (
  select page_id, octet_length(payload) as payload_bytes, sha1(payload) as h from p
), f as (
  select *, min(page_id) over (partition by h, payload_bytes) as first_id from d
)
select page_id, payload_bytes,
  (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     1 + cast((cast('0x' || substr(f.h, 1 + 5 * (k // 4), 5) as bigint) // (1 << (5 * (3 - k % 4)))) % 32 as bigint), 1), '' order by k)
   from range(32) t(k)) as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from f
"""

MIX_SQL = """
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source collate "binary" nulls last) - 1 as place from rows group by source
), w as (
  select *, 3 * source_size as most, case place % 3 when 0 then 5 when 1 then 2 else 1 end as weight, sum(source_size) over () as total from s
), o as (
  select *, (total - coalesce(sum(most) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as rate
  from w window before as (order by most / weight, place rows between unbounded preceding and 1 preceding)
), f as (
  select *, weight * rate > most as capped from o
), t as (
  select source, source_size, case when capped then most::double
    else weight * ((total - sum(case when capped then most else 0 end) over ())::double / sum(case when capped then 0 else weight end) over ()::double) end as target
  from f
), e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t
), b as (
  select r.doc_id, r.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as budget,
    sum(r.size) over (partition by r.source order by r.h, r.doc_id rows unbounded preceding) as upto
  from rows r join e on r.source is not distinct from e.source
)
select doc_id, size::bigint as size, source_size, target,
  (size * (epochs + case when upto - size + upto <= 2 * budget then 1 else 0 end))::bigint as taken
from b
"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds without bounds: each is a common table expression of distances to all entries."""
    out = [f"""
with v as materialized (
  select vec_id, label, row_number() over (order by vec_id) as r,
    list_transform(embedding, lambda e: floor(4096 * e::double)::bigint) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), p as materialized (
  select r, k as part, x[k * (len(x) // {parts}) + 1:(k + 1) * (len(x) // {parts})] as x from v, range({parts}) t(k)
), c0 as materialized (
  select part, r - 1 as entry, x from p where r <= {entries}
)"""]
    for turn in range(rounds + 1):
        out.append(f"""a{turn} as materialized (
  select p.r, p.part, min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * {entries} + c.entry) as m
  from p join c{turn} c using (part) group by p.r, p.part
)""")
        if turn < rounds:
            out.append(f"""u{turn} as materialized (
  select part, entry, list(m order by i) as x from (
    select part, entry, i, floor(sum(p.x[i + 1]) / count(*))::bigint as m
    from a{turn} join p using (r, part) join (select distinct part, entry from c{turn}) c using (part), range(0, 64) t(i)
    where m % {entries} = entry and i < len(p.x) group by part, entry, i) group by part, entry
), c{turn + 1} as materialized (
  select c.part, c.entry, coalesce(u.x, c.x) as x from c{turn} c left join u{turn} u using (part, entry)
)""")
    out.append(f"""f as (
  select r, string_agg(lpad(lower(to_hex(m % {entries})), 2, '0'), '' order by part) as code, sum(m // {entries})::bigint as error from a{rounds} group by r
), g as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from c{rounds}
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from v join f using (r), g""")
    return ", ".join(out)
