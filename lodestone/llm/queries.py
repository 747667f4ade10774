"""The queries that apply each operator, with production parameters, to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, codes, html, jaccard, licenses, mixing, packing, pii, quality, secrets, tokencounts, tokenfiles, whitening
from .common import gone_with_session, shared_dir, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets._joined(F.col("base")), 256).alias("base_sha256"), secrets._joined(F.col("spans")).alias("spans"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_pass", "mix_order")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), ann.fit(vectors))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write_files(table(spark, sf_dir, "documents"), path)
    gone_with_session(spark, path)
    return tokenfiles.read_files(spark, path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.context_limits(tokencounts.length_histogram(table(spark, sf_dir, "documents")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings")).drop("label")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_mixing, op3_neighbours, op4_token_files, op5_token_counts, op6_licenses, op7_packing, op8_html, op9_jaccard, op10_quality, op11_personal_data, op12_whitening, op13_codes, pipeline)}

_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP10 = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
w as (select *, regexp_extract_all(t, {_WORDS}) as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
windows as (select r, i, array_to_string(ws[i:i + 7], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
again as (select r, i from (select *, count(*) over (partition by r, g) as c from windows) where c > 1),
covered as (select r, count(distinct i + k) as n from again, range(0, 8) as x(k) group by r),
f as (select doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines,
  coalesce(n, 0)::bigint as n_repeat_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) as n_alpha_words from w left join covered using (r)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 20 * n_words or 100 * n_alpha_words < 60 * n_words or 2 * n_dup_lines > n_lines) as kept
from b"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _op6() -> str:
    rows = ", ".join(f"('{name}', {k}, '{gram}', {size})" for name, k, gram, size in licenses.template_rows())
    t = licenses.THRESHOLD
    return f"""
with tpl(license, template, gram, size) as (values {rows}),
d as (select doc_id, coalesce(text, '') as t, row_number() over () as r from documents),
u as (select doc_id, r, -1 as unit, t from d union all select doc_id, r, unnest(range(len(string_split(t, chr(10))))) as unit, unnest(string_split(t, chr(10))) as t from d),
w as (select doc_id, r, unit, list_filter(regexp_split_to_array(translate(t, {_LETTERS}), '[^a-z0-9]+'), lambda x: x <> '') as ws from u),
g as (select doc_id, r, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as gs from w where len(ws) > 1),
e as (select doc_id, r, unit, len(gs) as n, unnest(gs) as gram from g),
s as (select doc_id, r, unit, license, template, 2 * count(*) / (any_value(size) + any_value(n)) as dice from e join tpl using (gram) group by doc_id, r, unit, license, template),
b as (select *, row_number() over (partition by r, unit order by dice desc, license, template) as k from s where dice >= {t} - 1e-12)
select doc_id, unit::bigint as unit, license, round(dice, 9) as dice from b where k = 1"""




def _op13(rounds: int = codes.ROUNDS, parts: int = codes.PARTS, entries: int = codes.ENTRIES) -> str:
    def nearest(k: int) -> str:
        return f"""
far{k} as (select pos, part, weight, e, list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - entry[i]) * (part[i] - entry[i])))::bigint as d from parts join book{k} using (pos)),
best{k} as (select pos, part, any_value(weight) as weight, arg_min(e, (d, e)) as e, min(d) as d from far{k} group by pos, part)"""

    def replaced(k: int) -> str:
        return f"""{nearest(k)},
comps{k} as (select pos, e, i, sum(weight * part[i])::hugeint as s, sum(weight)::hugeint as c from best{k}, range(1, (select w + 1 from size)) as r(i) group by pos, e, i),
means{k} as (select pos, e, list(((s - ((s % c) + c) % c) // c)::bigint order by i) as entry from comps{k} group by pos, e),
book{k + 1} as (select pos, e, coalesce(m.entry, b.entry) as entry from book{k} b left join means{k} m using (pos, e))"""

    return f"""
with kept as (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
size as (select (max(len(x)) // {parts})::bigint as w from kept),
cut as (select r, vec_id, label, pos, x[pos * w + 1:(pos + 1) * w] as part from kept, size, range({parts}) as p(pos)),
parts as (select pos, part, count(*) as weight from cut group by pos, part),
firsts as (select row_number() over (order by vec_id nulls last, x) - 1 as e, x from kept qualify e < {entries}),
book0 as (select pos, e, x[pos * w + 1:(pos + 1) * w] as entry from firsts, size, range({parts}) as p(pos)),
{",".join(replaced(k) for k in range(rounds))},
{nearest(rounds)},
sha as (select sha256(string_agg(v, ',' order by pos, e)) as codebooks_sha256 from (select pos, e, array_to_string(entry, ',') as v from book{rounds})),
coded as (select r, vec_id, label, string_agg(printf('%02x', e), '' order by pos) as code, sum(d)::bigint as error from cut join best{rounds} using (pos, part) group by r, vec_id, label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded, sha"""


ORACLE_SQL = {"op6_licenses": _op6(), "op10_quality": _OP10, "op13_codes": _op13()}
