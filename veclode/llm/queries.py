"""The operators' queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact, importance, line_dedup, mixing, negatives, packing, pieces, quality, secrets, simhash, substring, topk, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": _on("documents", line_dedup.digest),
    "op2_quality_ranking": lambda spark, sf_dir: quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_exact_topk": _on("embeddings", topk.search),
    "op4_piece_sampling": _on("documents", pieces.digest),
    "op5_toxicity": lambda spark, sf_dir: toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_substring_dedup": _on("documents", substring.digest),
    "op7_source_mixing": _on("documents", mixing.mixed),
    "op8_simhash_near_dedup": _on("documents", simhash.digest),
    "op9_secret_scan": _on("documents", secrets.digest),
    "op10_exact_dedup": _on("documents", exact.exact_dedup),
    "op11_sequence_packing": _on("documents", packing.digest),
    "op12_importance_resampling": lambda spark, sf_dir: importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_hard_negatives": _on("embeddings", negatives.digest),
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
        with l as (select doc_id, i - 1 pos, ls[i] line from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents) d, range(1, len(ls) + 1) r(i)),
        k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from l),
        f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10),
        m as (select k.*, f.key is not null dropped from k left join f on k.key = f.key)
        select doc_id, count(*) n_lines, count(*) filter (dropped) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) kept_sha256
        from m group by doc_id
    """,
    "op3_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) v from embeddings
                   where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id vec_id, list_inner_product(q.v, c.v)::bigint score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
        r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::integer rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
    "op6_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
        p as (select doc_id, i, ws[i] w, ws[i:i + 34] win from d, range(1, len(ws) + 1) r(i)),
        h as (select doc_id, i, w, case when len(win) = 35 then sha256(array_to_string(win, ' ')) end h from p),
        m as (select doc_id, i, w, h is not null and count(*) over (partition by h) > 1 again from h),
        k as (select doc_id, i, w, bool_or(again) over (partition by doc_id order by i rows between 34 preceding and current row) gone from m),
        s as (select doc_id, count(*) filter (gone) n_removed, sha256(coalesce(string_agg(w, ' ' order by i) filter (not gone), '')) kept_sha256 from k group by doc_id)
        select d.doc_id, len(ws)::bigint n_words, coalesce(n_removed, 0) n_removed, coalesce(kept_sha256, sha256('')) kept_sha256 from d left join s using (doc_id)
    """,
    "op7_source_mixing": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size, md5(doc_id::varchar) o from documents),
        s as (select source, sum(size)::bigint source_size, (row_number() over (order by source nulls last) - 1) % 3 i from d group by source),
        w as (select *, case i when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end w, 2.0::double * source_size cap from s),
        l as (select *, cap / w r, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source rows between unbounded preceding and 1 preceding), 0))
                     / sum(w) over (order by cap / w, source rows between current row and unbounded following) level from w),
        t as (select source, source_size, coalesce(least(cap, w * (select max(level) from l where r > level)), cap) target from l),
        q as (select d.*, source_size, target, coalesce(sum(size) over (partition by d.source order by o rows between unbounded preceding and 1 preceding), 0) before
              from d join t on d.source is not distinct from t.source)
        select doc_id, size::bigint size, source_size, target,
               (greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - before - source_size)))::bigint taken from q
    """,
    "op10_exact_dedup": """
        with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
        select doc_id, max(doc_id) over (partition by t) keep_id, count(*) over (partition by t) group_size,
               doc_id = max(doc_id) over (partition by t) kept, sha256(t) text_sha256 from n
    """,
    "op12_importance_resampling": r"""
        with recursive d as materialized (select 0 k, doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents
                union all select 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
        p as (select k, id, i, ws[i] w from d, range(1, len(ws) + 1) r(i)),
        names as materialized (select w, x, len(x) // 2 size from (select w, hex(encode(w)) x from (select distinct w from p))),
        -- CRC-32 is linear: sh is what byte j of a register, with value b, becomes n zero bytes later
        b0 as materialized (select b, list_reduce([b] || range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) t(b)),
        step as (select 0::bigint n, j, b, b << (8 * j) v from range(256) t(b), range(4) u(j)
                 union all select n + 1, s.j, s.b, xor(s.v >> 8, b0.v) from step s join b0 on b0.b = s.v & 255 where n <= (select max(size) from names)),
        sh as materialized (select n, j, b, n * 1024 + j * 256 + b key, v from step),
        start as materialized (select n, bit_xor(v) ones from sh where b = 255 group by n),
        bytes as (select w, size, size - i + 1 n, ('0x' || substr(x, 2 * i - 1, 2))::bigint b from names, range(1, size + 1) r(i)),
        plain as (select w, size, bit_xor(v) c from bytes join sh on key = bytes.n * 1024 + bytes.b group by w, size),
        word as materialized (select w, size + 1 n, xor(xor(c, a.ones), 4294967295) c, xor(xor(xor(c, sp.v), z.ones), 4294967295) after_space
                 from plain join start a on a.n = size join start z on z.n = size + 1 join sh sp on sp.key = (size + 1) * 1024 + 32),
        one as materialized (select k, id, i, c, lead(after_space) over q s, lead(n) over q n from p join word using (w) window q as (partition by k, id order by i)),
        two as materialized (select k, id, i, xor(xor(xor(s0.v, s1.v), xor(s2.v, s3.v)), s) c, lead(s) over q s, lead(o.n) over q n from one o
                 join sh s0 on s0.key = o.n * 1024 + (c & 255) join sh s1 on s1.key = o.n * 1024 + 256 + ((c >> 8) & 255)
                 join sh s2 on s2.key = o.n * 1024 + 512 + ((c >> 16) & 255) join sh s3 on s3.key = o.n * 1024 + 768 + (c >> 24) window q as (partition by k, id order by i)),
        three as (select k, id, xor(xor(xor(s0.v, s1.v), xor(s2.v, s3.v)), s) c from two o
                 join sh s0 on s0.key = o.n * 1024 + (c & 255) join sh s1 on s1.key = o.n * 1024 + 256 + ((c >> 8) & 255)
                 join sh s2 on s2.key = o.n * 1024 + 512 + ((c >> 16) & 255) join sh s3 on s3.key = o.n * 1024 + 768 + (c >> 24)),
        f as materialized (select k, id, c % 10000 b from (select k, id, c from one union all select k, id, c from two union all select k, id, c from three)),
        s as (select b, count(*) n from f where k = 0 group by b),
        t as (select b, count(*) n from f where k = 1 group by b),
        gain as (select b, floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * ((select count(*) from f where k = 0) + 10000) / ((coalesce(s.n, 0) + 1.0::double) * ((select count(*) from f where k = 1) + 10000))))::bigint w
                 from range(10000) r(b) left join s using (b) left join t using (b)),
        w as (select id, count(*) n, sum(w)::bigint weight from f join gain using (b) where k = 0 group by id),
        u as (select id, len(ws) words, coalesce(n, 0) n_features, coalesce(weight, 0) weight,
                     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score
              from d left join w using (id) where k = 0),
        r as (select id, row_number() over (order by score desc, id) rank from u where words >= 20)
        select id doc_id, n_features, weight, score, case when rank <= 5 * (select count(*) from r) // 100 then rank end rank from u left join r using (id)
    """,
    "op13_hard_negatives": """
        with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
                   where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id a, a.l = b.l same, b.vec_id b, list_inner_product(a.v, b.v)::bigint score from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        p as (select a, b, score from (select *, row_number() over (partition by a order by score desc, b) n from s where same) where n <= 5),
        n as (select p.a, p.b pid, p.score ps, s.b nid, s.score ns, (row_number() over (partition by p.a, p.b order by s.score desc, s.b))::integer rank
              from p join s on p.a = s.a where not same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
        select a anchor_id, pid positive_id, rank, nid negative_id, ps positive_score, ns negative_score from n where rank <= 3
    """,
}
