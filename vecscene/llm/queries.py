"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import align, bpe, decontaminate, fingerprints, html_extract, licenses, near_dedup, quality, runs, shards, substring_dedup, token_counts, url_filter
from .common import read

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The two sides of the alignment.
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(read(spark, sf_dir, "documents"), 40)


def edits_of(docs: DataFrame) -> DataFrame:
    """Four edits for each document: a heading, a replacement in the middle, a deletion at two thirds, a line at the end."""
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    edit = lambda seq, start, deleted, inserted: F.struct(F.lit(seq).alias("seq"), start.cast("long").alias("start"), F.lit(deleted).alias("n_deleted"), inserted.alias("inserted"))
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    all_ = F.array(edit(0, F.lit(0), 0, F.concat(source, F.lit(": "))), edit(1, F.floor(n / 2), 3, F.concat(F.lit(" it's 2024, "), lang)), edit(2, F.floor(n * 2 / 3), 12, F.lit("")), edit(3, n + 1_000_000, 0, F.concat(F.lit("\n\nEnd of "), source)))
    return docs.select("doc_id", F.explode(all_).alias("e")).select("doc_id", "e.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return token_counts.count_edited(docs, edits_of(docs), VOCABULARY)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read(spark, sf_dir, "documents"), VOCABULARY)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digest(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(read(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_digest(read(spark, sf_dir, "documents"), BYTES, PIECES)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digest(read(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_sharding, op3_token_counts, op4_license_scans, op5_url_filters, op6_benchmark_decontamination, op7_byte_bpe, op8_substring_dedup, op9_html_extraction, op10_quality_rules, op11_tokenizer_alignment, op12_periodic_runs, op13_document_fingerprints)}

_WORD = r"[^\x20\x09-\x0D]"
_OP8 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents),
  spot as (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13),
  win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from spot),
  first as (select s, min(doc_id) as m from win group by s),
  gone as (select distinct doc_id, p from (select win.doc_id, unnest(range(i, i + 13)) as p from win join first using (s) where win.doc_id > m)),
  word as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from d),
  kept as (select word.doc_id, string_agg(x, ' ' order by word.p) as t, count(*) as n from word left join gone on gone.doc_id = word.doc_id and gone.p = word.p where gone.p is null group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id"""

_OP10 = f"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents),
  spot as (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) > 8),
  win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as s from spot),
  twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as c from win) where c > 1),
  rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 8)) as p from twice) group by 1),
  line as (select * from (select doc_id, host, t, unnest(string_split(t, chr(10))) as l from d) where regexp_matches(l, '{_WORD}')),
  dup as (select doc_id, count(*) - count(distinct l) as n, sum(length(l)) as chars from line group by 1),
  common as (select host, h from (select host, lower(trim(l)) as h, count(distinct t) as n from line group by 1, 2) where n > {quality.MAX_DOCS}),
  cut as (select doc_id, sum(length(l)) as n from line join common on common.host = line.host and common.h = lower(trim(l)) group by 1),
  f as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(dup.chars, 0) as chars, coalesce(cut.n, 0) as removed
    from d left join dup on dup.doc_id = d.doc_id left join rep on rep.doc_id = d.doc_id left join cut on cut.doc_id = d.doc_id),
  g as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words as base_failed from f)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and not (chars - removed < {quality.MIN_LEFT}e0 * chars) as kept, removed::bigint as n_removed_chars from g"""

_SPLIT = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def _op4() -> str:
    sets = [(f"{label}/{k}", label, tokens, licenses.span_of(x)) for label, all_ in licenses.TEMPLATES.items() for k, x in enumerate(all_) for tokens in [licenses._tokens(x)]]
    values = ", ".join(f"('{name}', '{label}', {tokens!r}, {span})" for name, label, tokens, span in sets)
    places = " union all ".join(
        f"select doc_id, '{label}' as label, i - 1 as pos from n where " + " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split())) for label, phrase in licenses.PHRASES.items()
    )
    lower = f"translate(coalesce(text, ''), '{licenses._UPPER}', '{licenses._LOWER}')"
    return f"""
with d as (select doc_id, list_filter(string_split_regex({lower}, '{_SPLIT}'), lambda x: x <> '') as w from documents),
  n as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d where list_contains(w, 'license')),
  p as ({places}),
  b as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list_distinct(list(label)) as labels from p group by 1),
  t as (select *, ceil({licenses.THRESHOLD}e0 * len(tokens) - 1e-9) as need from (values {values}) as v(name, label, tokens, span)),
  said as (select doc_id, i, ws[i] as w from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from (select doc_id, string_split_regex(lower(text), '{_SPLIT}') as ws from documents))),
  o as (select doc_id, name, i, w from said join (select name, unnest(tokens) as w from t) using (w)),
  maybe as (select doc_id, name from o join t using (name) group by 1, 2, need having count(distinct w) >= need),
  near as (select o.* from o join maybe using (doc_id, name)),
  win as (select a.doc_id, a.name, a.i, count(distinct b.w) as c from near a join t on t.name = a.name join near b on b.doc_id = a.doc_id and b.name = a.name and b.i >= a.i and b.i < a.i + t.span group by 1, 2, 3),
  hit as (select doc_id, label, c / len(tokens)::double as score from win join t using (name) where c >= need),
  m as (select doc_id, max(score) as score, list_distinct(list(label)) as labels from hit group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []::varchar[]), coalesce(m.labels, []::varchar[])))), ',') as labels,
  case when n_base > 0 then 1e0 else coalesce(score, 0e0) end as score
from d left join b on b.doc_id = d.doc_id left join m on m.doc_id = d.doc_id"""


ORACLE_SQL: dict[str, str] = {"op4_license_scans": _op4(), "op8_substring_dedup": _OP8, "op10_quality_rules": _OP10}
