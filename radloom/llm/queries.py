"""The registered queries of the numbered operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from radloom.llm import alignment, ann, bitslice, bpe, chat, collocations, language, line_templates, mixing, secrets, sharding, simhash, warc
from radloom.llm.common import shared_folder, stored
from radloom.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register ``fn(whole table)`` under a name."""
    def register(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(tune(spark).read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@query("op1_simhash_near_dedup", "documents")
def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    return simhash.near_duplicates(docs, distance=4, blocks=6, shingle=4).select(
        F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query("op2_vector_shards", "documents")
def vector_shards(docs: DataFrame) -> DataFrame:
    return sharding.pack_shards(docs, shards=24).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")


OP3_SQL = """
with docs as (select doc_id, string_split(text, chr(10)) as lines from documents where text is not null),
lines as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from docs),
parsed as (
  select doc_id, pos, [case when regexp_matches(x, '[0-9]') then '<*>' else x end
    for x in string_split(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')), ' ')] as tokens from lines),
usable as (
  select *, tokens[4:] as rest, len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') as leaf
  from parsed where len(tokens) >= 2 and array_to_string(tokens, ' ') <> ''),
busy as (
  select leaf from usable where len(tokens) > 3 group by leaf
  having count(distinct doc_id) >= 3 and count(distinct tokens) > 1),
places as (select leaf, unnest(rest) as token, unnest(range(len(rest))) as place from usable where leaf in (select leaf from busy)),
shares as (
  select *, sum(lines) over (partition by leaf, place) as total,
         row_number() over (partition by leaf, place order by lines desc, token desc) as nth
  from (select leaf, place, token, count(*) as lines from places group by all)),
constants as (
  select leaf, place, token from shares where nth = 1 and lines >= 0.5 * total and token <> '<*>'),
agreeing as (
  select doc_id, pos, u.leaf from (select doc_id, pos, leaf, unnest(rest) as token, unnest(range(len(rest))) as place, len(rest) as width from usable) u
  join constants c on c.leaf = u.leaf and c.place = u.place and c.token = u.token
  group by doc_id, pos, u.leaf, u.width having count(*) >= 0.7 * u.width),
by_leaf as (
  select doc_id, pos, first from agreeing join (
    select leaf, min(doc_id) as first from agreeing group by leaf having count(distinct doc_id) >= 3) using (leaf)),
by_text as (
  select doc_id, pos, first from usable join (
    select tokens, min(doc_id) as first from usable group by tokens having count(distinct doc_id) >= 3) using (tokens)),
gone as (
  select t.doc_id, t.pos from (
    select coalesce(l.doc_id, x.doc_id) as doc_id, coalesce(l.pos, x.pos) as pos, coalesce(l.first, x.first) as first
    from by_leaf l full join by_text x on l.doc_id = x.doc_id and l.pos = x.pos) t where t.doc_id <> t.first),
marks as (select doc_id, list(pos order by pos) as drops from gone group by doc_id)
select d.doc_id, coalesce(len(lines), 0)::int as n_lines, coalesce(len(drops), 0)::int as n_dropped,
       case when drops is null then d.text
            else array_to_string([lines[i + 1] for i in range(len(lines)) if not list_contains(drops, i)], chr(10)) end as text
from documents d left join docs using (doc_id) left join marks using (doc_id)
"""


@query("op3_line_templates", "documents", OP3_SQL)
def line_dedup(docs: DataFrame) -> DataFrame:
    return line_templates.drop_lines(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_lines", F.size("drops").alias("n_dropped"), F.col("kept").alias("text"))


@query("op4_language_id", "documents")
def language_id(docs: DataFrame) -> DataFrame:
    model = language.train(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id", language.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


@query("op5_multi_index_ann", "embeddings")
def multi_index_ann(embeddings: DataFrame) -> DataFrame:
    return ann.nearest(embeddings, every=20)


OP6_SQL = """
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
  from docs group by source),
levels as (
  select *, 2.0::double * source_size as cap,
         (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over w, 0))
           / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from sources
  window w as (order by 2.0::double * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select *, least(cap, weight * (select level from levels where level * weight <= cap order by cap / weight, source nulls last limit 1)) as target
  from levels),
plan as (
  select *, case when source_size > 0 then least(floor(target / source_size), 2)::bigint else 0 end as base from targets),
sums as (
  select docs.*, source_size, target, base, target - base * source_size as remainder,
         sum(size) over (partition by docs.source order by hash) as upto,
         sum(size) over (partition by docs.source, hash) as here
  from docs join plan on docs.source is not distinct from plan.source)
select doc_id, size, source_size, target,
       size * (base + case when upto <= remainder and remainder > 0 then 1
                           when upto - here <= remainder and remainder - (upto - here) > upto - remainder then 1 else 0 end)::bigint as taken
from sums
"""


@query("op6_source_mix", "documents", OP6_SQL)
def source_mix(docs: DataFrame) -> DataFrame:
    rows = stored(mixing.sized(docs))
    return mixing.apply_mix(rows, mixing.plan_mix(rows, (5, 2, 1), 1.5, 2.0), key="key").select(
        F.col("row.key").alias("doc_id"), "row.size", "source_size", "target", (F.col("row.size") * F.col("copies")).alias("taken"))


OP7_SQL = """
with vectors as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding])),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from vectors q join vectors c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


@query("op7_bit_sliced_top_k", "embeddings", OP7_SQL)
def bit_sliced_top_k(embeddings: DataFrame) -> DataFrame:
    return bitslice.highest(embeddings, every=50, k=5, scale=256)


@query("op8_bpe_round_trip", "documents")
def bpe_round_trip(docs: DataFrame) -> DataFrame:
    coded = bpe.round_trip(docs.select("doc_id", "text"), bpe.load(public_tokenizers.path("byte_bpe_50k.json")))
    return coded.select("row.doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


OP9_SQL = """
with payloads as (
  select page_id, coalesce(html, '') as html from pages),
digests as (
  select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as payload_digest from payloads),
originals as (
  select payload_digest, max(page_id) as original from digests where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest,
       case when original is null or original = page_id then 'response' else 'revisit' end as record_type,
       case when original <> page_id then original end as refers_to
from digests left join originals using (payload_digest)
"""


@query("op9_warc_captures", "pages", OP9_SQL)
def warc_captures(pages: DataFrame) -> DataFrame:
    folder = shared_folder(pages.sparkSession, "warc")
    warc.write_archives(warc.deduplicated(pages), folder)
    return warc.resolved(warc.assemble(pages.sparkSession, folder))


@query("op10_secret_entropy", "documents")
def secret_entropy(docs: DataFrame) -> DataFrame:
    found = secrets.find_secrets(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["order"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["order"] == k)).cast("long")
    return found.select(
        "row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


@query("op11_chat_round_trip", "conversations")
def chat_round_trip(conversations: DataFrame) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    added = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    parts = chat.format_turns(conversations.select("conv_id", "turn", "role", "text").union(added))
    return chat.read_back(parts).withColumnRenamed("conversation", "conv_id")


OP12_SQL = """
with texts as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents where text is not null),
pieces as (select lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as words from texts),
places as (select lang, words, unnest(range(1, len(words) + 1)) as i from pieces where len(words) > 0),
grams as (
  select lang, words[i:i] as phrase from places
  union all select lang, words[i:i+1] from places where i + 1 <= len(words)
  union all select lang, words[i:i+2] from places where i + 2 <= len(words)),
f as (select lang, phrase, len(phrase) as size, count(*)::bigint as a from grams group by lang, phrase),
totals as (select lang, sum(a)::bigint as n from f where size = 1 group by lang),
candidates as (select * from f where size > 1 and a >= 10),
cuts as (select lang, phrase, size, a, unnest(range(1, size)) as k from candidates),
scored as (
  select c.*, l.a as l, r.a as r, (1000000::hugeint * c.a * c.a // (l.a::hugeint * r.a))::bigint as score
  from cuts c join f l on l.lang = c.lang and l.phrase = c.phrase[1:c.k] join f r on r.lang = c.lang and r.phrase = c.phrase[c.k+1:]),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (
  select distinct b.lang, b.phrase from candidates b join candidates t
    on b.lang = t.lang and b.size = 2 and t.size = 3 and b.phrase in (t.phrase[1:2], t.phrase[2:3]) and 100 * t.a >= 50 * b.a),
kept as (select lang, array_to_string(phrase, ' ') as phrase, a, l, r, score from best anti join covered using (lang, phrase)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


@query("op12_phrase_collocations", "documents", OP12_SQL)
def phrase_collocations(docs: DataFrame) -> DataFrame:
    return collocations.collocations(docs, least=10, longest=3, covered=0.5, first=2000)


@query("op13_tokenizer_alignment", "documents")
def tokenizer_alignment(docs: DataFrame) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    found = alignment.align_corpus(docs.select("doc_id", "text"), bpe.load(public_tokenizers.path("byte_bpe_50k.json")), model)
    return found.withColumnRenamed("key", "doc_id").drop("groups")
