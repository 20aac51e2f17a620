"""Registered queries of the training-data operators, and their SQL.

The queries are thin: each applies its operator to the whole table it is meant
for and derives the contract's digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocation, decontamination, fingerprint, language_id, mixing, quality, secret_scan, spelling, token_counts, url_filter, warc
from .ngram_join import jaccard_components
from .runtime import Workspace, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    """Column: the row belongs to the fifth that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def language_model(spark: SparkSession, documents: DataFrame) -> language_id.LanguageModel:
    training = documents.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang")
    return language_id.fit(spark, training)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.identify(spark, docs.select("doc_id", "text"), language_model(spark, docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(spark, _table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, _table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.scan(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontamination.contaminated(20).alias("contaminated"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    good = _table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    model = quality.fit(spark, docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text"), good)
    out = quality.score(spark, docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(spark, _table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


PROBE = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(probe)))


def mixing_input(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", "source", "lang", mixing.topic_of("text").alias("topic"), mixing.word_count("text").alias("n_tokens"))


def op8_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, mixing_input(_table(spark, sf_dir, "documents")), power=0.5, rate=0.5)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup after four batches, one of which is sent twice: all documents
    under each tokenizer version, then the removal of exact copies and new counts
    for texts without their license lines.

    Of the rows of one text (null: empty) one stays: the smallest doc_id, null
    last, then source and language in order, null last."""
    docs = _table(spark, sf_dir, "documents")
    work = Workspace(spark, "tokens")
    versions = tuple(token_counts.PATTERNS)
    licensed = F.contains(F.coalesce("text", F.lit("")), F.lit("Licensed under"))
    bare = F.regexp_replace("text", r"(?m)^[^\n]*Licensed under[^\n]*$", "")
    counts = [c for v in versions for c in (v, f"bare_{v}")]
    counted = work.table(
        docs.select("source", "lang", "doc_id", "text")
        .select(
            "doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), licensed.alias("licensed"), bare.alias("bare"),
            *[token_counts.pattern_tokens("text", v).alias(v) for v in versions],
        )
        .select(
            "doc_id", "source", "lang", "digest", *versions,
            *[F.when(F.col("licensed"), token_counts.pattern_tokens("bare", v)).otherwise(F.col(v)).alias(f"bare_{v}") for v in versions],
        )
    )

    def changes(df, op, version, n, old=None, times=None):
        return df.select(
            F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), F.col(n).alias("n_tokens"),
            (F.col(old) if old else F.lit(None).cast("bigint")).alias("old_tokens"), (F.col(times) if times else F.lit(1)).cast("bigint").alias("times"),
        )

    def both(make):
        a, b = [make(v) for v in versions]
        return a.unionByName(b)

    rollup = token_counts.TokenRollup(spark, f"{shared_dir(spark)}/{work.root.rsplit('/', 1)[1]}-rollup")
    for v in versions:
        rollup.commit(f"load {v}", changes(counted, "insert", v, v))
    # Copies are counted per text, source and language before they are joined.
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("id"), F.col("source").isNull().alias("b"), F.col("source").alias("s"), F.col("lang").isNull().alias("c"), F.col("lang").alias("l"))
    per = work.table(counted.groupBy("digest", "source", "lang", *counts).agg(F.count("*").alias("k"), F.min(order).alias("low")))
    first = work.table(per.groupBy("digest", *counts).agg(F.min("low").alias("first"), F.sum("k").alias("all")))
    extra = per.join(first.where("all > 1").select("digest", "first"), "digest").withColumn("times", F.col("k") - F.col("low").eqNullSafe(F.col("first")).cast("int")).where("times > 0")
    copies = both(lambda v: changes(extra, "delete", v, v, times="times"))
    rollup.commit("remove copies", copies)
    rollup.commit("remove copies", copies)
    kept = first.select(F.col("first.s").alias("source"), F.col("first.l").alias("lang"), *counts)
    rollup.commit("no license lines", both(lambda v: changes(kept.where(f"`{v}` <> `bare_{v}`"), "revise", v, f"bare_{v}", v)))
    rollup.compact()
    return rollup.totals()


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spark, _table(spark, sf_dir, "documents"), least=5, times=5, shortest=6, drop_every=199)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(spark, _table(spark, sf_dir, "pages"), least=100)
    return out.select(F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(spark, _table(spark, sf_dir, "documents"), longest=4, least=30, factor=2_000_000, share=80, top=2_000)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filters": op6_url_filters,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_mixing_weights": op8_mixing_weights,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scans": op10_secret_scans,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_warc": op12_warc,
    "op13_phrase_collocations": op13_phrase_collocations,
    "pipeline": pipeline,
}

_N = r"coalesce(len(regexp_extract_all({0}, '{1}')), 0)"
_WORDS, _ALNUM = r"[^\x20\x09-\x0D]+", "[0-9A-Za-z]+"
_BARE = r"regexp_replace(text, '(?m)^[^\n]*Licensed under[^\n]*$', '', 'g')"

ORACLE_SQL = {
    "op4_benchmark_decontamination": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item, least(len(w), 13) as k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as s
        from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct k from win),
pos as (select doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') as s
        from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)),
hits as (select doc_id, item, p.k, i from pos p join win using (s, k)),
hw as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from hits) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hw using (doc_id) left join it using (doc_id)
""",
    "op6_url_filters": r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
             coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') as path from u),
r(verdict, rh, rp) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(verdict, length(rh || rp)) as verdict
      from h join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join m using (page_id)
""",
    "op9_token_counts": f"""
with d as (select *, row_number() over (partition by coalesce(text, '') order by doc_id nulls last, source nulls last, lang nulls last) as r, {_BARE} as bare from documents),
c as (select source, lang, 'words-1' as tokenizer_version, {_N.format('bare', _WORDS)} as n from d where r = 1
      union all select source, lang, 'alnum-1', {_N.format('bare', _ALNUM)} from d where r = 1)
select source, lang, tokenizer_version, cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_tokens from c group by 1, 2, 3
""",
    "op11_spelling_variants": r"""
with recursive bits(c, k, v) as (select i, 0, i from range(256) t(i) union all select c, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
tab as (select list(v order by c) as t from bits where k = 8),
runs as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
own as (select doc_id, run, count(*) as n from runs where length(run) >= 6 group by 1, 2),
chars as (select doc_id, run, n, string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, '') as cs from own),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(cs, lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end))), lambda a, b: xor(a >> 8, t[cast(xor(a & 255, b) + 1 as int)])), 4294967295::bigint) as h from chars, tab),
cut as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
w as (select word, cast(sum(n) as bigint) as n from cut where length(word) >= 6 group by 1 having sum(n) >= 5),
pos as (select word, n, unnest(range(1, length(word) + 1)) as i from w),
del as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as d from pos),
sub as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from pos),
near as (select a.word, b.word as near, b.n as near_n from sub a join sub b using (i, d) where a.word <> b.word
 union all select del.word, w.word, w.n from del join w on w.word = del.d
 union all select w.word, del.word, del.n from del join w on w.word = del.d),
best as (select word, count(*) as n_near, max(near_n) as m from near group by 1),
f as (select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when m >= 5 * w.n then (select min(near) from near x where x.word = w.word and x.near_n = m) end as form, case when m >= 5 * w.n then m end as form_n from w left join best b using (word)),
up(word, root) as (select word, word from f union all select up.word, f.form from up join f on f.word = up.root where f.form is not null),
r as (select word, arg_max(root, n) as root from (select up.word, up.root, f.n from up join f on f.word = up.root) group by 1)
select f.word, form, root, f.n, cast(n_near as bigint) as n_near, form_n from f join r using (word)
""",
    "op12_warc": """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages),
f as (select *, min(page_id) over (partition by html) as f from p)
select page_id, payload_bytes, sha256(html) as payload_digest, case when payload_bytes < 100 or page_id is not distinct from f or f is null then 'response' else 'revisit' end as record_type,
       case when payload_bytes >= 100 and page_id is distinct from f then f end as refers_to from f
""",
    "op13_phrase_collocations": r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, m, array_to_string(w[i : i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from w, range(1, 5) t(m) where len(w) >= m)),
c as (select lang, m, phrase, count(*) as f from g group by all having count(*) >= 30),
tot as (select lang, cast(sum(len(w)) as bigint) as n from w group by 1 having sum(len(w)) > 0),
cand as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from c where m > 1),
cuts as (select lang, phrase, a, k, array_to_string(w[1 : k], ' ') as lp, array_to_string(w[k + 1 : m], ' ') as rp from (select *, unnest(range(1, m)) as k from cand)),
sc as (select q.lang, q.phrase, q.a, q.k, x.f as l, y.f as r, cast((2000000::hugeint * q.a) // (x.f + y.f) as bigint) as score
 from cuts q join c x on x.lang = q.lang and x.phrase = q.lp join c y on y.lang = q.lang and y.phrase = q.rp),
best as (select * from sc qualify row_number() over (partition by lang, phrase order by score, k) = 1),
sub as (select lang, phrase as longer, a, m, w, j, unnest(range(1, m - j + 2)) as i from cand, range(2, 4) t(j) where j < m),
cover as (select lang, array_to_string(w[i : i + j - 1], ' ') as phrase, max(a) as f from sub group by 1, 2),
kept as (select b.* from best b left join cover v using (lang, phrase) where v.f is null or 100::hugeint * v.f < 80::hugeint * b.a),
r as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from r join tot using (lang) where rank <= 2000
""",
}
