"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import bpe, centroids, chat, grammar, mixing, pii, quality, repair, repeats, sharding, simhash, syncmers, topk
from darkroom.llm.common import literal_rows, shared_dir, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of each document; see mixing.mixed."""
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as grammar shards, reads them back: doc_id, start, n_tokens and ids_crc32."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/token-grammar-{uuid.uuid4().hex}"
    grammar.written(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            n = pa.array([len(x.as_buffer()) // 4 for x in ids], pa.int64())
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return grammar.read(spark, path).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; see quality.fit and quality.scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: the 5 best rows for each row whose vec_id is divisible by 50."""
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("id % 50 = 0"), 5).withColumnRenamed("id", "vec_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; see bpe.encoded."""
    import public_tokenizers

    docs = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    n = (F.octet_length("ids") / 4).cast("long")
    return docs.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation, read back from its formatted text and segments, and whether the template's machine
    accepts its order of roles; see chat.formatted."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = literal_rows(spark, [{"conv_id": -7, "turn": i, "role": r, "text": said} for i, r in enumerate(("user", "assistant"))], "conv_id: long, turn: long, role: string, text: string")
    out = chat.formatted(turns.unionByName(own)).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss_text"))
    hashed = lambda x: F.sha2(x.cast("binary"), 256)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hashed(spoken).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        hashed(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document; see repeats.without_repeats."""
    out = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike it is to the latter and to the next document.

    The edited text ends, in place of the last third, with the beginning of the next document by descending id.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = syncmers.with_next(docs, then=lambda df: df.withColumn("found", syncmers.anchors(F.col("text"))))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.withColumn("edited_found", syncmers.anchors(F.col("edited")))
    return rows.select(
        F.col("id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.fingerprint(F.col("found")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        syncmers.likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of each document; see simhash.near_duplicates."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, seed=42, threshold=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document; see sharding.sharded."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.sharded(rows, ["doc_id", "text_crc32", "size"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, how many emails, ip addresses, cards and phones stand in it undisguised, the hash of their spans, all spans
    and how many of them were disguised; see pii.found."""
    out = pii.found(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: ~s["added"])
    of = lambda kind: F.filter("spans", lambda s: (s["kind"] == kind) & ~s["added"])
    numbers = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select(F.col("id").alias("doc_id"), *numbers, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["added"])).cast("long").alias("n_added"))


def damaged(turns: DataFrame) -> DataFrame:
    """conversations, damaged by the hash of conv_id and turn: rows dropped, emptied, without signs at the end of
    sentences, repeated, or of role user. Nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _sha_of_pieces(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations in several pieces, read in order, a piece at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, begun, kind, out = None, hashlib.sha256(), False, pa.int64(), []
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, piece, spoken in zip(*(c.to_pylist() for c in batch.columns)):
                if piece == 0 and now is not None:
                    out.append((now[0], sha.hexdigest()))
                if piece == 0:
                    now, sha, begun = (conv,), hashlib.sha256(), False
                if spoken is not None:
                    sha.update((("\n" if begun else "") + spoken).encode())
                    begun = True
        if now is not None:
            out.append((now[0], sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], kind), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])

    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "piece", F.when(F.size("turns") > 0, _spoken()).alias("spoken"))
    return rows.mapInArrow(of, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def _spoken() -> Column:
    return F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each damaged conversation; see
    repair.repaired. One whose rows are all dropped has zeros, an empty audit and the hash of nothing."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pieces = repair.repaired(damaged(turns))
    one = pieces.where("pieces = 1").select("conv_id", F.sha2(_spoken().cast("binary"), 256).alias("repaired_sha256"))
    hashes = one.unionByName(_sha_of_pieces(pieces.where("pieces > 1")))
    known = repair.report(pieces).withColumnRenamed("conv_id", "_conv")
    out = turns.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    out = out.join(hashes.withColumnRenamed("conv_id", "_hashed"), F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of 64 components; see
    centroids.sort_means: 40 centroids, 5 rounds."""
    rows = centroids.quantised(table(spark, sf_dir, "embeddings"))
    start = centroids.seeds(rows, 40, F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256))
    return centroids.with_inertia(*centroids.sort_means(rows, start, 5)).withColumnRenamed("id", "vec_id").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_mixing, op2_token_grammar, op3_quality, op4_topk, op5_bpe, op6_chat, op7_repeats, op8_syncmers, op9_simhash, op10_sharding,
            op11_pii, op12_repair, op13_centroids,
        )
    }


#: Words of a text in DuckDB: the same runs as common.WORD.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP1 = rf"""
with sized as (
  select doc_id, source, len({_WORDS})::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || coalesce(text, '')), 1, 15))::bigint as h
  from documents
), per_source as (
  select source, sum(size)::bigint as source_size,
         ((row_number() over (order by source is null, source collate "binary") - 1) % 3 + 1)::double as weight
  from sized group by source
), capped as (
  select *, (3 * source_size)::double as cap, (3 * source_size)::double / weight as ratio from per_source
), rated as (
  select *,
         (sum(source_size::double) over () - coalesce(sum(cap) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by ratio, source is null, source rows between current row and unbounded following) as rate
  from capped
), final as (
  select rate from rated where rate <= ratio order by ratio, rate limit 1
), plan as (
  select source, source_size, least(cap, weight * (select rate from final)) as target from rated
), copies as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from plan
), by_hash as (
  select source, h, sum(sum(size)) over (partition by source order by h)::bigint as upto from sized group by source, h
)
select s.doc_id, s.size, c.source_size, c.target,
       (s.size * case when c.source_size = 0 then 0
         else c.whole + (b.upto <= floor(c.target)::bigint - c.whole * c.source_size)::bigint end)::bigint as taken
from sized s join copies c on s.source is not distinct from c.source
join by_hash b on s.source is not distinct from b.source and s.h = b.h
"""

_OP4 = """
with good as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from good q join good c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

_SAID = r"'\### Assistant: </turn> ok'"
_ESCAPED = r"replace(replace(replace(replace({}, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c')"
_OP6 = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', {_SAID} union all select -7, 1, 'assistant', {_SAID}
), joined as (
  select conv_id, count(*)::bigint as n_turns,
         string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as spoken,
         coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as lost,
         regexp_full_match(string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end, '' order by turn, role, text), 's?(ua)+') as valid,
         sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + length('### : </turn>') + 1)::bigint as formatted_chars
  from turns group by conv_id
)
select conv_id, n_turns, sha256(spoken) as turns_sha256, length(lost)::bigint as loss_chars, sha256(lost) as loss_sha256, formatted_chars, valid
from joined
"""

_OP7 = rf"""
with docs as (
  select row_number() over () as r, doc_id, {_WORDS} as words from documents
), starts as (
  select r, doc_id, words, unnest(range(1, len(words) - 33)) as i from docs where len(words) >= 35
), windows as (
  select r, i, md5(array_to_string(words[i:i + 34], ' ')) as h from starts
), again as (
  select r, i from windows where h in (select h from windows group by h having count(*) > 1)
), gone as (
  select distinct r, unnest(range(i, i + 35)) as i from again
), places as (
  select r, unnest(range(1, len(words) + 1)) as i, unnest(words) as word from docs
), kept as (
  select p.r, string_agg(p.word, ' ' order by p.i) filter (g.i is null) as text, count(g.i)::bigint as n_removed
  from places p left join gone g on p.r = g.r and p.i = g.i group by p.r
)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join kept k on d.r = k.r
"""


#: CRC-32 of an ASCII string, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end)))"""

_OP12 = rf"""
with recursive original as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
  from conversations
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from original where kind <> 0
), placed as (
  select *, coalesce(conv_id::varchar, ' ') as conv, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said,
         row_number() over (partition by conv_id order by turn nulls first, role collate "binary", text collate "binary", copy) as i
  from damaged
), judged as (
  select *, left(role, 1) as r,
         case when said = '' then 'b' when row_number() over (partition by conv, role, text order by i) > 1 then 'd'
              when right(said, 1) not in ('.', '!', '?') then 't' else '' end as fault,
         coalesce(lag(left(role, 1)) over (partition by conv order by i) || left(role, 1) not in ('su', 'ua', 'au'), false) as bad
  from placed
), moves(state, role, next) as (
  values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), names(role, name) as (
  values ('u', 'user'), ('a', 'assistant')
), inserts(state, next, cost, audit, out) as (
  select s, s, 0, '', [] from range(4) t(s)
  union all select m.state, m.next, 3, 'I', [n.name || ':'] from moves m join names n using (role)
  union all select m.state, o.next, 6, 'II', [n.name || ':', k.name || ':'] from moves m join names n using (role)
            join moves o on o.state = m.next join names k on k.role = o.role
), walk as (
  select conv, 0::bigint as i, 0 as state, 0::bigint as cost, '' as audit, []::varchar[] as out from (select distinct conv from placed)
  union all
  select conv, i, state, cost, audit, out from (
    select w.conv, j.i, e.state, w.cost + n.cost + e.cost as cost, w.audit || n.audit || e.edit as audit, w.out || n.out || e.out as out
    from walk w join judged j on j.conv = w.conv and j.i = w.i + 1 join inserts n on n.state = w.state,
    lateral (
      select n.next as state, 4 as cost, 'D' as edit, []::varchar[] as out
      union all select m.next, case when j.fault = 't' then 3 else 0 end, 'K', [j.role || ':' || j.text] from moves m
                where m.state = n.next and m.role = j.r and j.fault not in ('b', 'd')
      union all select m.next, case when j.fault = 't' then 6 else 3 end, 'R', [a.name || ':' || j.text] from moves m join names a using (role)
                where m.state = n.next and j.fault not in ('b', 'd')
    ) e
  ) qualify row_number() over (partition by conv, state order by cost, audit collate "binary") = 1
), ended as (
  select w.conv, w.cost + n.cost as cost, w.audit || n.audit as audit, w.out || n.out as out
  from walk w join (select conv, max(i) as n from placed group by conv) l on l.conv = w.conv and l.n = w.i join inserts n on n.state = w.state
  where n.next in (0, 3) qualify row_number() over (partition by w.conv order by w.cost + n.cost, w.audit || n.audit collate "binary") = 1
), counted as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, (count(*) filter (fault = 'b'))::bigint as blank,
         (count(*) filter (fault = 'd'))::bigint as duplicate, (count(*) filter (fault = 't'))::bigint as truncated, (count(*) filter (bad))::bigint as illegal
  from judged group by conv
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
       coalesce(audit, '') as audit, sha256(coalesce(array_to_string(out, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from original) o
left join counted c on c.conv = coalesce(o.conv_id::varchar, ' ') left join ended e on e.conv = c.conv
"""


def _op13(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    near = lambda n: f"""a{n} as materialized (
  select r, min({{'d': g.ss - 2 * list_inner_product(g.v, c.v) + list_inner_product(c.v, c.v), 'c': c.c}}) as m from good g cross join c{n} c group by r
)"""  # noqa: E731
    steps = []
    for n in range(rounds):
        steps.append(near(n))
        steps.append(f"""m{n} as (
  select c, i, floor(sum(x) / count(*)) as x from (select a.m.c as c, unnest(g.v) as x, unnest(range({width})) as i from a{n} a join good g using (r)) group by c, i
), c{n + 1} as materialized (
  select c.c, coalesce(l.v, c.v) as v from c{n} c left join (select c, list(x order by i) as v from m{n} group by c) l using (c)
)""")
    steps.append(near(rounds))
    return f"""
with good as materialized (
  select row_number() over () as r, vec_id, v, list_inner_product(v, v) as ss from (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  )
), c0 as materialized (
  select row_number() over (order by vec_id is null, sha256('2:' || vec_id), v) - 1 as c, v from good
  order by vec_id is null, sha256('2:' || vec_id), v limit {k}
), {", ".join(steps)}
select g.vec_id, a.m.c::int as cluster, a.m.d::bigint as distance, sum(a.m.d) over (partition by a.m.c)::bigint as cluster_inertia,
       sum(a.m.d) over ()::bigint as inertia, sha256(array_to_string(list_transform(c.v, lambda x: x::bigint), ',')) as centroid_sha256
from a{rounds} a join good g using (r) join c{rounds} c on c.c = a.m.c
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express; tests hold the others against brute force."""
    return {"op1_mixing": _OP1, "op4_topk": _OP4, "op6_chat": _OP6, "op7_repeats": _OP7, "op12_repair": _OP12, "op13_centroids": _op13()}
