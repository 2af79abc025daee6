"""One query per operator, over whole tables and whole texts, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillet.llm import forest, lines, minhash, mixing, packing, quality, substrings, tokens, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The public vocabulary of the packed ids.
PACKING_VOCABULARY = "word_bpe_49k.json"
#: The public vocabulary of the word pieces that are counted.
TOKEN_VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(PACKING_VOCABULARY))


@_query("op2_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op4_lines")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


_URL_SQL = """
with cut as (
  select page_id, case when contains(url, '://') then regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') else '' end as rest from pages
), parts as (
  select page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when contains(rest, '/') then substr(rest, strpos(rest, '/')) else '' end as path from cut
), rules(rule, said, h, p) as (values
  ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), fit as (
  select parts.*, rule, said, row_number() over (partition by page_id order by length(rule) desc nulls last) as nth
  from parts left join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, p)
)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(said, 'allow') as verdict from fit where nth = 1
"""


@_query("op5_urls", _URL_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


_QUALITY_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), grams as (
  select doc_id, i, array_to_string(words[i:i+4], ' ') as gram from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)
), twice as (
  select doc_id, i from grams qualify count(*) over (partition by doc_id, gram) > 1
), repeated as (
  select doc_id, count(distinct i + k) as n_repeat_words from twice, (select unnest(range(0, 5)) as k) group by doc_id
), f as (
  select doc_id, text, words, cast(len(words) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from w left join repeated using (doc_id)
), g as (
  select *, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) as n_stutters, len(list_distinct(words)) as kinds,
    len(regexp_extract_all(text, '[0-9]')) as n_digits
  from f
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 5 * n_stutters > n_words or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 25 * n_words
    or 2 * n_digits > word_chars or 2 * n_dup_lines > len(lines) or (n_words >= 50 and 20 * kinds < least(n_words, 400))) as kept
from g
"""


@_query("op8_quality", _QUALITY_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@_query("op7_tokens")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary(TOKEN_VOCABULARY))


@_query("op10_embeddings")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op9_substrings")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).drop("kept")
