"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightwords.llm import ann, chat, exact_dedup, langid, mixing, packing, periodic, pii, simhash, substrings, toxicity, warc, whitening
from flightwords.llm.common import WORD, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op7_exact_dedup", r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over g keep_id, count(*) over g group_size,
       row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 kept, text_sha256
from t window g as (partition by text_sha256)
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return marks.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


@query("op9_mixing", r"""
with words as (
  select doc_id, source, md5(coalesce(text, '')) tie,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
d as (
  select *, length(size::varchar) * 100 + rpad(size::varchar, 2, '0')[1:2]::int band,
         ('0x' || md5(coalesce(doc_id::varchar, ''))[1:4])::int % 256 bucket from words),
per as (select source, sum(size)::bigint source_size from d group by source),
weighed as (
  select *, [1.0::double, 2.0, 3.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w, source_size * 3.0::double cap from per),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over b, 0)) / (sum(w) over () - coalesce(sum(w) over b, 0)) lvl
  from weighed window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select lvl from levels where lvl * w <= cap order by cap / w limit 1),
goal as (select source, source_size, w, cap, coalesce(least(cap, (select lvl from level) * w), cap) target from levels),
ranked as (
  select *, row_number() over (partition by source order by band, bucket, size, doc_id nulls last, tie) rank from d),
steps as (
  select r.doc_id, r.size, g.source_size, g.target, r.rank,
         case when g.source_size > 0 then g.target / g.source_size else 0.0::double end rate,
         ('0x' || md5('42|' || coalesce('1' || r.source, '0'))[1:8])::bigint::double / 4294967296.0::double u
  from ranked r join goal g on r.source is not distinct from g.source)
select doc_id, size, source_size, target,
       (floor(rank * rate + u) - floor((rank - 1) * rate + u))::bigint * size taken from steps
""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.copies(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op5_chat_format", r"""
with c as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') body from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
       sum(length(body) + 8 + case role when 'system' then 12 when 'user' then 10 when 'assistant' then 15
           else 14 + length(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ')) + ends_with(role, '#')::int end)::bigint formatted_chars
from e group by conv_id
""")
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    chats = chat.format_chats(rows.unionByName(hard))
    turns = chat.read_back(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", "formatted", "valid", turns.alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = simhash.groups(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ids=False)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold(F.col("doc_id"), 5) == 0
    found = langid.predict(docs, langid.fit(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    held_out = langid.fold(F.col("doc_id"), 3) == 1
    found = toxicity.score(docs, toxicity.fit(docs.filter(~held_out), labels.filter(~held_out)))
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "sentences"
    )


@query("op4_nearest")
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op2_warc", r"""
with p as (select page_id, coalesce(html, '') payload from pages),
d as (select page_id, strlen(payload) payload_bytes, sha1(payload) h, max(page_id) over (partition by payload) kept from p),
b as (
  select *, array_to_string(list_transform(range(40), lambda i: lpad(bin(('0x' || h[i + 1])::int), 4, '0')), '') bits from d)
select page_id, payload_bytes::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 +
    list_sum(list_transform(range(5), lambda j: bits[5 * i + j + 1]::int * (16 >> j)))::int]), '') payload_digest,
  case when page_id = kept then 'response' else 'revisit' end record_type,
  case when page_id <> kept then kept end refers_to from b
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.history(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_substrings", r"""
with d as (select doc_id, coalesce(text, '') t, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n_bytes from documents),
w as (
  select doc_id, i, substr(h, (2 * i + 1)::int, 100) s
  from (select doc_id, h, unnest(range(n_bytes - 49)) i from d where n_bytes >= 50)),
m as (select s, min(doc_id) first from w group by s),
c as (select distinct w.doc_id, i from w join m using (s) where m.first < w.doc_id),
g as (select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end is_new from c),
r as (select *, sum(is_new) over (partition by doc_id order by i) run from g),
spans as (select doc_id, run, min(i) a, max(i) + 50 b from r group by doc_id, run),
gaps as (
  select doc_id, a, b, lag(b, 1, 0) over (partition by doc_id order by a) before from spans),
kept as (
  select g.doc_id, string_agg(substr(h, (2 * before + 1)::int, (2 * (a - before))::int), '' order by a) head, max(b) tail, sum(b - a)::bigint removed, count(*) n
  from gaps g join d using (doc_id) group by g.doc_id)
select d.doc_id, n_bytes::bigint n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans,
       sha256(unhex(coalesce(head || substr(h, (2 * tail + 1)::int), h))) kept_sha256
from d left join kept using (doc_id)
""")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(table(spark, sf_dir, "documents"), texts=False)


def _spans_text(spans):
    """kind:start:end, comma-joined; spans are in the order of kinds, then starts."""
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


@query("op11_pii")
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.array_remove(F.transform("base.kind", lambda x: x != k), True)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    every = F.array_sort(F.concat("base", "found"))
    return found.select("doc_id", *counts, F.sha2(_spans_text(F.col("base")), 256).alias("base_sha256"), _spans_text(every).alias("spans"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: in documents whose checksum ends in 0 the words from some place on repeat what stands there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD}+)"), F.lit(1))
    own = docs.select("doc_id", "text", (F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull()).alias("chosen"), g.alias("g"))
    own = own.withColumn("w", F.when(F.col("chosen"), words)).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    turn = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    turned = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", turn(i).cast("int")))
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_periods(table(spark, sf_dir, "documents")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    one = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return one.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
        F.floor(1000 * -F.col("best.l") / F.col("best.p")).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = whitening.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whitening.whiten(x, whitening.fit(x)).withColumnRenamed("id", "vec_id")
