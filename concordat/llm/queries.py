"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the files are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.tokenfiles import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), keep=False)


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.warc import capture_history

    history = capture_history(table(spark, sf_dir, "pages"))
    return history.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at", "range_no", "position"
    )


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.quality_rules import quality_rules

    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.toxicity import held_out, toxicity_scores

    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


@query
def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.ranking import held_out, quality_scores

    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.hmm import held_out, language_model_scores

    scored = language_model_scores(table(spark, sf_dir, "documents"), ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.dedup import removed_bytes

    return removed_bytes(table(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.fim import fill_in_middle, restored

    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


ORACLES["op12_fill_in_middle"] = r"""
with dealt as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || cast(doc_id as varchar)) as h from documents
), cut as (
  select doc_id, text,
    regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens,
    cast('0x' || substr(h, 1, 8) as ubigint) as h1, cast('0x' || substr(h, 9, 8) as ubigint) as h2,
    cast('0x' || substr(h, 17, 8) as ubigint) as h3, cast('0x' || substr(h, 25, 8) as ubigint) as h4
  from dealt
), placed as (
  select doc_id, text, tokens, len(tokens) as n,
    least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from cut
), parts as (
  select doc_id, text, n, form, array_to_string(tokens[1:a], '') as p, array_to_string(tokens[a + 1:b], '') as m,
    array_to_string(tokens[b + 1:], '') as s
  from placed
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), one_in=31)


def _crc32_sql(nibbles: str) -> str:
    """crc32 of a list of half bytes, the lower half of each byte first, by a table of 16 remainders."""
    remainders = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        remainders.append(x)
    fold = f"xor(c >> 4, cast({remainders} as ubigint[])[cast(xor(c, x) & 15 as integer) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {nibbles}), lambda c, x: {fold}), 4294967295::ubigint)"


_HEX = "hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run))"
_NIBBLES = f"list_transform(range(length({_HEX})), lambda i: cast(instr('0123456789ABCDEF', {_HEX}[i + 2 - 2 * (i % 2)]) - 1 as ubigint))"

ORACLES["op11_spelling_variants"] = rf"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) as run
  from documents
), hashed as (
  select run, times, {_crc32_sql(_NIBBLES)} as h
  from (select doc_id, run, count(*) as times from runs where length(run) >= 7 group by all)
), words as materialized (
  select case when h % 31 = 0 then run[:cast(h % length(run) as integer)] || run[cast(h % length(run) as integer) + 2:] else run end as word,
    cast(sum(times) as bigint) as n
  from hashed group by 1 having n >= 2 and length(word) >= 7
), shorter as materialized (
  select word, n, length(word) as size, i, word[:i - 1] || word[i + 1:] as rest
  from words, unnest(range(1, length(word) + 1)) as u(i)
), pairs as (
  select a.word as a, a.n as a_n, b.word as b, b.n as b_n from shorter a join shorter b
    on a.rest = b.rest and a.size = b.size and a.i = b.i and a.word <> b.word
  union select a.word, a.n, b.word, b.n from shorter a join words b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from shorter a join words b on a.rest = b.word
), best as (
  select a, count(*) as n_near, first(b order by b_n desc, b) as b, max(b_n) as b_n, first(a_n) as n from pairs group by a
), formed as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when b_n >= 10 * w.n then b end as form, case when b_n >= 10 * w.n then b_n end as form_n
  from words w left join best on best.a = w.word
), chain as (
  select word, word as at from formed
  union all select chain.word, formed.form from chain join formed on formed.word = chain.at where formed.form is not null
), last as (
  select chain.word, chain.at as root from chain join formed on formed.word = chain.at where formed.form is null
)
select formed.word, form, root, n, n_near, form_n from formed join last on last.word = formed.word
"""


@query
def op13_minmax_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from concordat.llm.minmax import minmax_duplicates

    return minmax_duplicates(table(spark, sf_dir, "documents"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
