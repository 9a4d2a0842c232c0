"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, line_dedup, mixing, neural_lm, ngram_join, secret_scan, token_files, toxicity, turn_repair, vector_codes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), carry=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
with d as (
  select doc_id, case when source is null then '1' else '0' || source end as src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
s as (select src, sum(size)::bigint as source_size from d group by src),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by src) - 1) % 3 + 1)::int]::double as w,
             2.0::double * source_size as ceiling from s),
f as (select *,
        coalesce(sum(ceiling) over (order by ceiling / w, src rows between unbounded preceding and 1 preceding), 0) as below,
        coalesce(sum(w) over (order by ceiling / w, src rows between unbounded preceding and 1 preceding), 0) as below_w,
        (sum(source_size) over ())::double * 1.5::double as total, sum(w) over () as total_w from w),
g as (select *, (total - below) / (total_w - below_w) as level from f),
h as (select *, first_value(case when ceiling > level * w then level end ignore nulls)
        over (order by ceiling / w, src rows between unbounded preceding and current row) as free_level from g),
t as (select src, source_size,
        case when free_level is null then ceiling else least(ceiling, free_level * w) end::double as target from h),
c as (select *, len(size::varchar) * 100 + substr(rpad(size::varchar, 2, '0'), 1, 2)::int as band,
        ((((((doc_id % 1073741824) + 1073741824) % 1073741824) * 2654435761) % 4294967296) // 65536) % 16 as split from d),
r as (select *, row_number() over (partition by src order by band, split, size, doc_id) as place from c),
m as (select doc_id, size, source_size, target, place,
        case when source_size > 0 then target / source_size else 0 end as rate,
        ('0x' || substr(md5(src || '|17'), 1, 8))::bigint / 4294967296.0::double as start
      from r join t using (src))
select doc_id, size, source_size, target,
       least(floor(place * rate + start) - floor((place - 1) * rate + start), 2)::bigint * size as taken
from m
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup.exact_duplicates(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""

def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ngram_join.similarity_join(table(spark, sf_dir, "documents")).components()
    return parts.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


OP8_SQL = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[]
           when len(ws) < 5 then [array_to_string(ws, ' ')]
           else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 75 * (a.n + b.n - o)),
r as (select x as a, x as b from (select distinct x from l) union select r.a, l.y from r join l on l.x = r.b),
c as (select a, min(b) as root from r group by a)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.root, w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id left join c on c.a = w.doc_id
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP9_SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents),
b as (
  select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from benchmark),
bw as (
  select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as win
  from (select item_id, ws, least(10, len(ws)) as n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i
        from b where len(ws) > 0)),
dw as (
  select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as win
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i
        from d, (select distinct n from bw) where len(ws) >= n)),
m as (select doc_id, item_id, n, i from dw join bw using (n, win)),
p as (select doc_id, count(distinct pos) as n_hit
      from (select doc_id, unnest(range(i, i + n)) as pos from (select distinct doc_id, n, i from m)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items
      from (select distinct doc_id, item_id from m) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p on p.doc_id = d.doc_id left join t on t.doc_id = d.doc_id
"""


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = [r.kind for r in secret_scan.BASE_RULES]
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.dedup_lines(docs, groups_of=line_dedup.alike_groups)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))
    return read.select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP3_SQL = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
         max(page_id) over (partition by coalesce(html, '')) as top from pages)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from p
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = language_id.fold("doc_id")
    model = language_id.train(docs.filter(remainder != 1))
    found = language_id.identify(docs, model, carry=["doc_id"])
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(neural_lm.fold("doc_id") == 2, F.lit(False))
    scored, model = neural_lm.score_documents(docs, docs.filter(~held))
    return scored.select(
        "doc_id",
        F.coalesce(neural_lm.fold("doc_id") == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.totals["tokens"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, frequencies = token_files.write_token_files(table(spark, sf_dir, "documents"))
    return token_files.read_token_files(manifest, frequencies)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    digits = F.lower(F.hex("code")).alias("code")
    out = vector_codes.with_label_error(coded).select("vec_id", digits, "error", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(books.sha256()))


def _op11_sql(rounds: int = 2) -> str:
    steps = [
        """kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as c from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        """parts as materialized (
  select vec_id, p::bigint as p, c[p * (len(c) // 16) + 1:(p + 1) * (len(c) // 16)] as x from kept, range(16) t(p))""",
        """b0 as (
  select p, e, x from parts
  join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 64) using (vec_id))""",
    ]
    for r in range(rounds + 1):
        square = "list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i])))"
        steps.append(f"""a{r} as materialized (
  select vec_id, p, any_value(q.x) as x, min({square}::bigint * 64 + e) as m from parts q join b{r} b using (p) group by vec_id, p)""")
        if r < rounds:
            steps.append(f"""s{r} as (
  select p, m % 64 as e, i, sum(x[i])::bigint as s, count(*) as n from a{r}, range(1, (select max(len(x)) + 1 from parts)) t(i) group by all)""")
            steps.append(f"""b{r + 1} as materialized (
  select b.p, b.e, coalesce(f.x, b.x) as x from b{r} b left join (
    select p, e, list((s - ((s % n) + n) % n) // n order by i) as x from s{r} group by p, e) f on f.p = b.p and f.e = b.e)""")
    steps.append(f"""o as (
  select vec_id, label, string_agg(printf('%02x', (m % 64)::int), '' order by p) as code, sum(m // 64)::bigint as error
  from a{rounds} join kept using (vec_id) group by vec_id, label)""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from b{rounds}) as codebooks_sha256
from o"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(toxicity.fold("doc_id") == 2, F.lit(False))
    model = toxicity.train(docs.filter(~held), table(spark, sf_dir, "labels"))
    found = toxicity.score_toxicity(docs, model, carry=["doc_id"])
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.repair(turn_repair.damage(talks)).summary()
    every = talks.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = F.sha2(F.lit(""), 256)
    return every.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", none).alias("repaired_sha256"),
    )


#: crc32 of an ASCII string s.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::bigint)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295)"""


def _op13_sql() -> str:
    """The best cost and edits by state of the grammar (x0 to x3), row by row for all conversations at once."""

    def move(x, cost, letter):
        return f"case when {x} is not null then {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}} end"

    def least(*some):
        return f"list_min([{', '.join(some)}])"

    def when(condition, x):
        return f"case when {condition} then {x} end"

    def keep(x, initial):
        return when(f"fault in (0, 3) and ini = '{initial}'", move(x, "5 * (fault = 3)::int", "K"))

    def rename(x):
        return when("fault in (0, 3)", move(x, "1 + 5 * (fault = 3)::int", "R"))

    def drop(x):
        return move(x, 2, "D")

    def insert(x):
        return move(x, 5, "I")

    before_user = ("x0", "x1", "y3")
    return f"""with recursive c as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         (coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')) as s from conversations),
h as (select *, {_CRC_SQL} % 20 as k from c),
d as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
         case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text, copy
  from h, range(2) t(copy) where k <> 0 and (copy = 0 or k = 3)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from d),
f as materialized (
  select conv_id, turn, role, text, i, substr(role, 1, 1) as ini, lead(substr(role, 1, 1)) over (partition by conv_id order by i) as following,
         case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1
              when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
              when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 3 else 0 end as fault from o),
p as (
  select conv_id, 0::bigint as i, {{'c': 0::bigint, 'a': ''}} as x0, null::struct(c bigint, a varchar) as x1,
         null::struct(c bigint, a varchar) as x2, null::struct(c bigint, a varchar) as x3 from (select distinct conv_id from f)
  union all
  select conv_id, i, {drop('x0')}, {least(drop('x1'), keep('x0', 's'))},
         {least(drop('y2'), *[keep(x, 'u') for x in before_user], *[rename(x) for x in before_user])},
         {least(drop('y3'), keep('y2', 'a'), rename('y2'))}
  from (select *, {least('x3', insert('y2'))} as y3 from (
    select p.conv_id, f.i, fault, ini, x0, x1, x3, {least('x2', insert('x0'), insert('x1'), insert('x3'))} as y2
    from p join f on f.conv_id is not distinct from p.conv_id and f.i = p.i + 1))),
e as (
  select p.conv_id, {least('x0', 'x3', insert('x2'), move('x1', 10, 'II'))} as best
  from p join (select conv_id, max(i) as i from f group by conv_id) n on n.conv_id is not distinct from p.conv_id and n.i = p.i),
l as (select conv_id, j, best.a[j] as letter from e, lateral (select unnest(range(1, len(best.a) + 1)) as j)),
g as (
  select *, sum((letter <> 'I')::int) over w as i, sum((letter <> 'D')::int) over w as n from l window w as (partition by conv_id order by j)),
t as (
  select g.conv_id, j, letter, g.n, role, case when letter = 'I' then '' else text end as text,
         max((letter = 'K' and ini = 's')::int) over (partition by g.conv_id) as sys
  from g left join f on f.conv_id is not distinct from g.conv_id and f.i = g.i where letter <> 'D'),
s as (
  select conv_id, sha256(string_agg(case when letter = 'K' then role when (n - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by j)) as sha
  from t group by conv_id),
q as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 1) as blank,
         count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
         count(*) filter (following is not null and ini || following not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join q on q.conv_id is not distinct from a.conv_id left join e on e.conv_id is not distinct from a.conv_id
left join s on s.conv_id is not distinct from a.conv_id"""


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc_bundles": op3_warc_bundles,
    "op4_language_id": op4_language_id,
    "op5_neural_lm": op5_neural_lm,
    "op6_token_files": op6_token_files,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_join": op8_ngram_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_secret_scan": op10_secret_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "op13_turn_repair": op13_turn_repair,
}

ORACLE_SQL = {
    "op1_mix_sources": OP1_SQL,
    "op3_warc_bundles": OP3_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op8_ngram_join": OP8_SQL,
    "op9_decontaminate": OP9_SQL,
    "op11_vector_codes": _op11_sql(),
    "op13_turn_repair": _op13_sql(),
}
