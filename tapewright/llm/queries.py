"""The registered queries of this subpackage: each applies its operator to the whole of its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, dialogue, html, lines, minhash, mpeg, pii, quality, spans, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """Ranks and pattern of a public vocabulary file."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = _digest(F.concat_ws(",", "items"))
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    encoded = bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, pattern)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _digest(ids).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = mpeg.read(mpeg.store(_table(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in {
        "frames": F.col("frames"), "samples": F.col("samples"), "rate": F.col("rate"), "seconds": F.format_number("seconds", 6), "kbps": F.concat_ws("+", F.col("kbps").cast("array<string>")), "crc": F.concat(F.col("checked") - F.col("bad_crc"), F.lit("/"), F.col("checked")),
        "tags": F.concat_ws("+", "tags"), "vbr": F.concat(F.col("vbr_frames"), F.lit("/"), F.col("vbr_bytes")), "toc": F.crc32("toc"), "toc_off": F.col("toc_off"), "seek": F.crc32(F.concat_ws(",", F.col("seek").cast("array<string>")).cast("binary")),
    }.items()))
    tail = F.crc32(F.substring("payload", -16, 16))
    return stored.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.section_counts(_table(spark, sf_dir, "documents"), *vocabulary())


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    listed = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat(x["kind"], F.lit(":"), x["start"], F.lit(":"), x["end"])))
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    counts = [_count(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, _digest(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"), _count("secret").cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))


def op7_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(_table(spark, sf_dir, "documents"), within=True)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.train(docs, quality.learnable(labels)))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", _digest(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    centre = _digest(F.array_join(F.col("centroid").cast("array<string>"), ","))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centre.alias("centroid_sha256"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialogue.damaged(_table(spark, sf_dir, "conversations"))
    return dialogue.repair_summary(dialogue.repaired_rows(rows))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.drop_repeated_bytes(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_byte_bpe, op3_minhash, op4_mpeg, op5_token_counts, op6_pii, op7_span_dedup, op8_quality, op9_html, op10_line_dedup, op11_centroids, op12_dialogue_repair, op13_suffix_dedup)}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_ALNUM = _WORDS.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLACK = _WORDS.format(r"[^\x20\x09-\x0D]+")


def _clusters_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Each round's assignment and centroids as two tables."""
    near = "(select vec_id, v, arg_min(n, (d, n)) n, min(d) d from (select vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) d from x cross join c{}) group by vec_id, v)"
    steps = [f"""x as materialized (select vec_id, list_transform(embedding, lambda e: cast(floor(1024 * e::double) as bigint)) v from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0)""",
        f"c0 as materialized (select row_number() over (order by sha256('3:' || vec_id)) - 1 n, v c from x order by sha256('3:' || vec_id) limit {k})"]
    for r in range(rounds):
        mean = "((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))"
        steps.append(f"a{r} as materialized {near.format(r)}")
        steps.append(f"m{r} as (select n, list(m order by j) c from (select n, j, cast({mean} as bigint) m from (select n, unnest(v) e, unnest(range({size})) j from a{r}) group by n, j) group by n)")
        steps.append(f"c{r + 1} as materialized (select n, coalesce(m.c, o.c) c from c{r} o left join m{r} m using (n))")
    return f"""with {", ".join(steps)}, z as materialized {near.format(rounds)}
select vec_id, cast(n as int) as cluster, cast(d as bigint) distance, cast(sum(d) over (partition by n) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(c, ',')) centroid_sha256 from z join c{rounds} using (n)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_centroids": _clusters_sql(),
        # In hexadecimal, by pieces of 200 bytes and the 200 after them, as a slice far into a text is slow.
        "op13_suffix_dedup": """
with d as materialized (select row_number() over () rid, doc_id, hex(encode(coalesce(text, ''))) h, cast(strlen(coalesce(text, '')) as bigint) n from documents),
c as materialized (select rid, n, j, substr(h, 400*j+1, 800) s from (select rid, n, h, unnest(range(n // 200 + 1)) j from d)),
w as materialized (select rid, n, 200*j + o i, substr(s, 2*o+1, 2) x, case when 200*j + o + 200 <= n then md5(substr(s, 2*o+1, 400)) end k from (select *, unnest(range(200)) o from c) where 200*j + o < n),
r as materialized (select k from w where k is not null group by k having count(*) > 1),
m as (select rid, i, x, coalesce(max(case when r.k is not null then i end) over (partition by rid order by i rows between 199 preceding and current row), -1) >= 0 gone from w left join r on w.k = r.k),
e as (select *, gone and not coalesce(lag(gone) over (partition by rid order by i), false) first from m),
a as (select rid, count(*) filter (where gone) n_removed, count(*) filter (where first) n_spans, coalesce(string_agg(x, '' order by i) filter (where not gone), '') kept from e group by rid)
select d.doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from d left join a using (rid)""",
        "op1_decontaminate": f"""
with d as (select doc_id, {_ALNUM} w from documents),
b as (select cast(item_id as varchar) item_id, {_ALNUM} w from benchmark),
win as (select distinct item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') win from (select item_id, w, least(10, len(w)) m, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
sizes as (select distinct m from win),
pos as (select doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') win from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from d, sizes where len(w) >= m)),
hit as (select distinct doc_id, i, p.m, p.win from pos p join (select distinct m, win from win) x on p.m = x.m and p.win = x.win),
covered as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i + m)) k from hit) group by 1),
items as (select doc_id, list_sort(list(distinct item_id)) items from hit h join win w on h.m = w.m and h.win = w.win group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(len(items), 0) as bigint) n_items, sha256(coalesce(array_to_string(items, ','), '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join covered using (doc_id) left join items using (doc_id)""",
        "op3_minhash": f"""
with recursive d as (select doc_id, {_BLACK} w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + k - 1), ' ') s from (select doc_id, w, least(5, len(w)) k, unnest(range(1, len(w) - least(5, len(w)) + 2)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
u as (select a, b from e union select b, a from e),
r as (select doc_id a, doc_id b from documents union select r.a, u.b from r join u on r.b = u.a)
select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, cast(m as bigint) component_id, d.doc_id = m kept
from d left join n using (doc_id) join (select a, min(b) m from r group by 1) on a = d.doc_id""",
        "op10_line_dedup": r"""
with l as (select doc_id, i, line, translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from (select doc_id, unnest(lines) line, unnest(range(len(lines))) i from (select doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents))),
f as (select k, min(doc_id) first from l where length(k) >= 10 group by 1),
m as (select doc_id, i, line, length(l.k) >= 10 and doc_id > first gone from l left join f on l.k = f.k)
select doc_id, count(*) n_lines, count(*) filter (where gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not coalesce(gone, false)), '')) kept_sha256 from m group by 1""",
    }
