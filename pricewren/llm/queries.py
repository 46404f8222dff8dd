"""Queries of this subpackage's operators over the documents table, and their SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewren.llm import bpe, exact_dedup, fingerprints, hard_negatives, html_text, language_id, lattice_lm, lexical, mixing, ngram_join, suffix_dedup, token_io, toxicity
from pricewren.llm.common import hash_mod

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Target weights of the mixing query: two domains are wanted more, as are English and Spanish.
MIX = {"domain_weights": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang_weights": {"en": 5, "es": 4, "de": 2, "fr": 2}, "source_weights": {"src0": 2}, "max_epochs": 3}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op3_token_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_io.round_trip(documents(spark, sf_dir), WORD_BPE, end_id=1)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir).drop("text_sha256"), **MIX)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epochs").alias("epochs"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(documents(spark, sf_dir).select("doc_id", "text"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(documents(spark, sf_dir))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    learns = hash_mod("doc_id", 7) != 2
    out = lattice_lm.score(documents(spark, sf_dir), learns, PIECES)
    return out.select("doc_id", (hash_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language_id.identify(docs.select("doc_id", "text", "lang"), hash_mod("doc_id", 5) != 0)
    return out.select("doc_id", (hash_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, hash_mod("doc_id", 5) != 0)
    return toxicity.predict(docs, model).select("doc_id", (hash_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(documents(spark, sf_dir), WORD_BPE))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.train(pages)).select("page_id", "url", "text", "n_chars")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_exact_dedup, op3_token_io, op4_mixing, op5_fingerprints, op6_ngram_join, op7_lattice_lm, op8_language_id, op9_toxicity, op10_bpe, op11_hard_negatives, op12_html_extraction, op13_lexical_search)}

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_DOMAIN = "case when regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) = '' then 'other' else 'd' || (cast(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1) as bigint) % 4) end"


def _case(column: str, weights: dict[str, int]) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


def _divide(name: str, children: str, parents: str, key: str) -> str:
    by = f"partition by {parents}" if parents else ""
    return f"""{name}_a as (select *, cast(capacity as hugeint) * 1000000 // weight as ratio from ({children}) where weight > 0),
{name}_b as (select *, cast(parent_budget as hugeint) - sum(capacity) over ({by} order by ratio, {key} rows unbounded preceding) + capacity as left_, sum(weight) over ({by} order by ratio, {key} rows between current row and unbounded following) as weight_left from {name}_a),
{name}_c as (select *, case when left_ * weight >= cast(capacity as hugeint) * weight_left then 0 else 1 end as short from {name}_b),
{name}_d as (select *, sum(short) over ({by} order by ratio, {key} rows unbounded preceding) as shorts from {name}_c),
{name}_e as (select *, max(case when short = 1 and shorts = 1 then left_ end) over ({by}) as num, max(case when short = 1 and shorts = 1 then weight_left end) over ({by}) as den from {name}_d),
{name} as (select *, cast(case when shorts = 0 then capacity else least(capacity, (num * weight) // den) end as bigint) as budget from {name}_e)"""


def mixing_sql(table: str = "documents", seed: int = 17) -> str:
    """Rows and epochs of the mixing query, as select over table."""
    m = MIX
    key = f"md5('{seed}' || ':' || epochs || ':' || coalesce(cast(doc_id as varchar), ''))"
    return f"""with d as (select *, coalesce(lang, '') as l, coalesce(source, '') as s, {_DOMAIN} as domain, {_WORDS} as tokens from {table}),
leaves as (select domain, l, s, cast(sum(tokens) as bigint) as supply, cast(sum(tokens) * {m["max_epochs"]} as bigint) as capacity, {_case("domain", m["domain_weights"])} as dw, {_case("l", m["lang_weights"])} as lw, {_case("s", m["source_weights"])} as sw from d group by domain, l, s),
root as (select least(cast(sum(supply) as bigint), cast(sum(capacity) as bigint)) as parent_budget from leaves),
{_divide("domains", "select domain, max(dw) as weight, cast(sum(capacity) as bigint) as capacity, (select parent_budget from root) as parent_budget from leaves group by domain", "", "domain")},
{_divide("langs", "select domain, l, max(lw) as weight, cast(sum(leaves.capacity) as bigint) as capacity, any_value(domains.budget) as parent_budget from leaves join domains using (domain) group by domain, l", "domain", "l")},
{_divide("sources", "select domain, l, s, sw as weight, leaves.supply as supply, leaves.capacity as capacity, langs.budget as parent_budget from leaves join langs using (domain, l)", "domain, l", "s")},
b as (select domain, l, s, case when supply > 0 then budget // supply else 0 end as epochs, budget - (case when supply > 0 then budget // supply else 0 end) * supply as rest from sources),
k as (select d.doc_id, d.domain, d.lang, d.source, d.n_chars, d.text, d.tokens, b.epochs, b.rest, d.l, d.s, {key} as key from d join b on d.domain = b.domain and d.l = b.l and d.s = b.s),
c as (select *, sum(tokens) over (partition by domain, l, s order by key) as taken from k),
taken as (select *, cast(epochs + case when rest > 0 and taken <= rest then 1 else 0 end as bigint) as n_epochs from c)"""


_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}')"

ORACLE_SQL = {
    "op2_exact_dedup": r"""with n as (select doc_id, length(coalesce(text, '')) as n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, cast(count(*) over (partition by t) as bigint) as group_size, first_value(doc_id) over w = doc_id as kept, sha256(t) as text_sha256
from n window w as (partition by t order by n_chars desc, doc_id)""",
    "op4_mixing": mixing_sql() + "\nselect doc_id, domain, lang, source, n_epochs as epochs from taken where n_epochs > 0",
    "op11_hard_negatives": """with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as q from embeddings
where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) as bigint) as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) as rn from s where same) where rn <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) as rn from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, cast(rn as integer) as rank, negative_id, positive_score, negative_score from n where rn <= 5""",
    "op13_lexical_search": f"""with d as (select doc_id, {_TERMS} as t from documents), d1 as (select doc_id, cast(len(t) as bigint) as n, t from d where len(t) > 0),
a as (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as l from d1), p as (select doc_id, n, term, cast(count(*) as bigint) as tf from (select doc_id, n, unnest(t) as term from d1) group by all),
q as (select distinct item_id, unnest({_TERMS}) as term from benchmark), w as (select term, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, a where term in (select term from q) group by term, nn),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // l)))) as bigint) as score from q join w using (term) join p using (term), a group by all)
select item_id, cast(rn as integer) as rank, doc_id, score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rn from s where score > 0) where rn <= 10""",
}
