"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import exact_search, language, line_rules, manifest, mixing, near_duplicates, packing, page_text, secrets, spelling, substrings, suffix_dedup, token_counts
from weir.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    # A row without an id has no remainder; it is learned from as little as one that is held out.
    model = language.train(docs.where(~F.col("held_out")))
    return language.predict(docs.withColumn("held_out", F.coalesce("held_out", F.lit(False))), model, keep=["doc_id", "held_out"])


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, folder))


@query
def op3_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    return exact_search.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id % 50 = 0")


@query
def op4_substrings(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.without_repeats(documents(spark, folder))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder))


@query
def op6_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.main_text(spark.read.parquet(f"{folder}/pages.parquet"))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document before and after its mail addresses and long numbers are masked."""
    trees = token_counts.with_trees(documents(spark, folder).select("doc_id", "text"))
    before = trees.withColumns({"n_tokens_before": F.col("n_tokens"), "edits": token_counts.replacements(
        F.col("text"), r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+[A-Za-z]|[0-9]{6,}", "[masked]")})
    after = token_counts.apply_edits(before)
    return after.select("doc_id", "n_tokens_before", F.coalesce(F.size("edits"), F.lit(0)).alias("n_edits"), "n_tokens", "n_encoded",
                        F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))


@query
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit(packing.with_near_clusters(documents(spark, folder)))


@query
def op9_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.quality(documents(spark, folder)).drop("cut_hashes")


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(documents(spark, folder))
    return found.select("doc_id", "position", "piece", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query
def op11_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's proof, checked with the leaf of a text that lost its line ends where 2 divides the id's CRC."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    spoiled = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    other = manifest.leaf(*[F.col(c) for c in columns[:-1]], spoiled)
    found = manifest.manifest(documents(spark, folder), columns, extra={"other": other})
    folded = manifest.folded(F.col("other"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


@query
def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder), spoil=31).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op13_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.without_repeats(documents(spark, folder))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op9_line_rules"] = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '') as host from documents),
w as (select doc_id, t, host, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
u as (select doc_id, unnest(w) as a, generate_subscripts(w, 1) as i from w),
g as (select doc_id, i, a, lead(a) over s as b, lead(a, 2) over s as c from u window s as (partition by doc_id order by i)),
f as (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from g where c is not null),
r as (select doc_id, count(distinct j) as n_repeat
      from (select doc_id, unnest([i, i + 1, i + 2]) as j from f where n > 1) group by 1),
ln as (select doc_id, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) as x
       from (select doc_id, host, unnest(l) as x from w)),
fr as (select host, x from ln group by 1, 2 having count(distinct doc_id) > 10),
cut as (select doc_id, count(*) as lines_cut, sum(len(string_split(x, ' '))) as words_cut
        from ln join fr using (host, x) group by 1),
m as (select doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars,
             len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words,
             coalesce(lines_cut, 0) as lines_cut, cast(coalesce(words_cut, 0) as bigint) as words_cut
      from w left join r using (doc_id) left join cut using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select *, not base_failed and 100 * (n_words - words_cut) >= 30 * n_words as kept from b"""

ORACLE["op5_mixing"] = r"""
with recursive
d as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n_tokens from documents),
s as (select source, cast(sum(n_tokens) as bigint) as source_tokens, count(*) as n from d group by 1),
t as (select sum(source_tokens) as total, list(source_tokens / (select cast(sum(source_tokens) as double) from s) order by source) as ps from s),
bis(k, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select k + 1, if(small, mid, lo), if(small, hi, mid)
  from (select k, lo, hi, mid, ln(z) - mid * zl / z > 0.97 * ln(len(ps)) or power(list_min(ps), mid - 1) / z > 4 as small
        from (select k, lo, hi, mid, ps, list_sum(list_transform(ps, lambda p: power(p, mid))) as z,
                     list_sum(list_transform(ps, lambda p: power(p, mid) * ln(p))) as zl
              from (select k, lo, hi, (lo + hi) / 2 as mid, ps from bis, t where k < 32)))),
e as (select round(hi, 6) as a, ps, total from bis, t where k = 32),
b as (select source, source_tokens, cast(ceil(n / 2000.0) as bigint) as blocks,
             cast(round(power(source_tokens / total::double, a) / list_sum(list_transform(ps, lambda p: power(p, a))) * total) as bigint) as source_budget
      from s, e),
h as (select *, cast('0x' || substr(md5('mix:b:' || doc_id), 1, 10) as bigint) % 1099511627776 % blocks as block,
             cast('0x' || substr(md5('mix:d:' || doc_id), 1, 10) as bigint) as dk from d join b using (source)),
o as (select *, sum(n_tokens) over (partition by source, block order by dk, doc_id rows unbounded preceding) as inside from h),
g as (select source, block, sum(bt) over (partition by source order by cast('0x' || substr(md5('mix:o:' || source || ':' || block), 1, 10) as bigint), block
             rows unbounded preceding) - bt as ahead
      from (select source, block, sum(n_tokens) as bt from h group by 1, 2))
select doc_id, source, n_tokens, source_tokens, source_budget, block, cast(ahead + inside - n_tokens as bigint) as "before",
       cast(source_budget // source_tokens + if(n_tokens > 0 and ahead + inside <= source_budget % source_tokens, 1, 0) as bigint) as copies
from o join g using (source, block)"""

ORACLE["op3_exact_search"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
      from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 5"""

ORACLE["op4_substrings"] = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
u as (select doc_id, unnest(generate_series(1, len(w) - 12)) as i, w from w where len(w) >= 13),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from u),
f as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as first from g) where first < doc_id),
c as (select doc_id, list(distinct j) as gone from (select doc_id, unnest(generate_series(i, i + 12)) as j from f) group by 1),
k as (select doc_id, len(w) as n_words, coalesce(len(gone), 0) as n_removed,
             case when gone is null then array_to_string(w, ' ')
                  else array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda j: not list_contains(gone, j)), lambda j: w[j]), ' ') end as t
      from w left join c using (doc_id))
select doc_id, cast(n_words as bigint) as n_words, cast(n_removed as bigint) as n_removed, sha256(t) as kept_sha256 from k"""

ORACLE["op11_manifest"] = r"""
with recursive
d as (select *, if(list_reduce(list_concat([4294967295], flatten(list_transform(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)),
               lambda b: [b + 256, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: if(x >= 0, xor(a, x - 256), xor(a >> 1, 3988292384 * (a & 1)))) % 2 = 1, replace(text, chr(10), ''), text) as t2 from documents),
e as (select doc_id, source, coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
             || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-') as head, text, t2 from d),
v as (select doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
             sha256(head || coalesce(octet_length(encode(t2)) || ':' || t2, '-')) as other from e),
p as (select *, row_number() over (partition by source order by doc_id, leaf) - 1 as pos from v),
up(source, level, nodes) as (
  select source, 0, list(leaf order by pos) from p group by source
  union all
  select source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) from up where len(nodes) > 1),
sub as (select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as rk from up where len(nodes) = 1),
top(level, nodes) as (
  select 0, list(subroot order by rk) from sub
  union all
  select level + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) from top where len(nodes) > 1),
height as (select source, max(level) as h from up group by 1),
steps as (select u.source, u.level, u.nodes, 0 as above from up u where len(nodes) > 1
          union all select h.source, h.h + t.level, t.nodes, 1 from top t, height h where len(t.nodes) > 1),
fold(doc_id, source, leaf, level, pos, rk, above, proof, node) as (
  select doc_id, p.source, leaf, 0, pos, rk, 0, '', other from p join sub s on p.source is not distinct from s.source
  union all
  select doc_id, source, leaf, level + 1, place // 3, rk, is_above, proof || before || after, sha256(before || node || after)
  from (select f.doc_id, f.source, f.leaf, f.level, f.rk, s.above as is_above, f.proof, f.node, place,
               array_to_string(s.nodes[place - place % 3 + 1:place], '') as before, array_to_string(s.nodes[place + 2:place - place % 3 + 3], '') as after
        from (select *, 0 as x from fold) f join steps s on s.source is not distinct from f.source and s.level = f.level,
             lateral (select if(s.above = 1 and f.above = 0, f.rk, f.pos) as place))),
last as (select *, row_number() over (partition by doc_id, leaf order by level desc) as r from fold)
select l.doc_id, l.leaf, s.subroot, (select nodes[1] from top where len(nodes) = 1) as root, sha256(l.proof) as proof_sha256, l.node as folded_root,
       l.node = (select nodes[1] from top where len(nodes) = 1) as verified
from last l join sub s on l.source is not distinct from s.source where r = 1"""

ORACLE["op13_suffixes"] = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
w as (select doc_id, unnest(range(greatest(len(x) // 2 - 99, 0))) as i, x from d),
g as (select doc_id, i, md5(x[2 * i + 1:2 * i + 200]) as g from w),
f as (select doc_id, i from (select doc_id, i, min(struct_pack(d := doc_id, i := i)) over (partition by g) as first from g) where first <> struct_pack(d := doc_id, i := i)),
s as (select doc_id, i, sum(new) over (partition by doc_id order by i) as s
      from (select doc_id, i, if(i <= lag(i) over (partition by doc_id order by i) + 100, 0, 1) as new from f)),
r as (select doc_id, min(i) as a, max(i) + 100 as b from s group by doc_id, s),
k as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from r),
c as (select d.doc_id, count(*) as n_spans, cast(sum(b - a) as bigint) as n_removed,
             string_agg(x[2 * before + 1:2 * a], '' order by a) || any_value(x)[2 * max(b) + 1:] as kept
      from k join d using (doc_id) group by 1)
select doc_id, len(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, x))) as kept_sha256
from d left join c using (doc_id)"""

ORACLE["op12_spelling"] = r"""
with recursive
r as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as w from documents),
u as (select doc_id, w, count(*) as k from r group by 1, 2),
h as (select w, k, xor(list_reduce(list_concat([4294967295], flatten(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || w)), '..'),
               lambda x: [cast('0x' || x as bigint) + 256, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: if(x >= 0, xor(a, x - 256), xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) as h from u),
v as (select if(h % 31 = 0, w[1:h % length(w)] || w[h % length(w) + 2:], w) as word, k from h),
n as (select word, cast(sum(k) as bigint) as n from v group by 1 having sum(k) >= 2 and length(word) >= 7),
c as (select word, n, i, word[1:i - 1] || word[i + 1:] as cut from (select word, n, unnest(range(1, length(word) + 1)) as i from n)),
p as (select a.word, b.word as near, b.n as near_n from c a join n b on a.cut = b.word
      union select b.word, a.word, a.n from c a join n b on a.cut = b.word
      union select a.word, b.word, b.n from c a join c b on a.cut = b.cut and a.i = b.i and a.word <> b.word),
m as (select word, count(*) as n_near, max(near_n) as most from p group by 1),
f as (select n.word, n.n, coalesce(n_near, 0) as n_near, if(most >= 10 * n.n, most, null) as form_n,
             if(most >= 10 * n.n, (select min(near) from p where p.word = n.word and p.near_n = m.most), null) as form
      from n left join m on n.word = m.word),
chain(word, root, step) as (select word, word, 0 from f union all select c.word, f.form, step + 1 from chain c join f on f.word = c.root and f.form is not null),
last as (select word, root from (select *, row_number() over (partition by word order by step desc) as r from chain) where r = 1)
select f.word, form, root, n, n_near, form_n from f join last using (word)"""
