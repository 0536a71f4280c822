"""The ten operators as registered queries: thin layers that put each operator's output into its contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontam, hard_negatives, hmm_lm, kdtree, langid, licences, ngram_join, packing, page_text, pii, toxicity, warc
from .common import bucket_of, small_batches


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), bucket_of("doc_id", 3) == 1
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(~held)
    labels = labels.filter("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    machine = toxicity.learn(docs.select("doc_id", "text").join(labels, "doc_id"))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kdtree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), bucket_of("doc_id", 7) == 2
    scored = hmm_lm.score(docs, docs.filter(~held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), bucket_of("doc_id", 3) == 1
    found = langid.identify(docs, langid.learn(docs.filter(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read(spark, sf_dir, "pages"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(read(spark, sf_dir, "conversations")), F.col("dropped"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_topk": op5_topk,
    "op6_pii": op6_pii,
    "op7_ngram_join": op7_ngram_join,
    "op8_hmm": op8_hmm,
    "op9_licences": op9_licences,
    "op10_language": op10_language,
    "op11_page_text": op11_page_text,
    "op12_conversations": op12_conversations,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}

_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ord(c)::bigint)),
            lambda c, b: xor(table256[1 + (xor(c, b) & 255)], c >> 8))"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op3_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as b, sha1(coalesce(html, '')) as d from pages),
        m as (select d, max(page_id) as last from p where b >= 1000 group by d)
        select p.page_id, cast(p.b as bigint) as payload_bytes, p.d as payload_digest,
               case when m.last is null or m.last = p.page_id then 'response' else 'revisit' end as record_type,
               case when m.last <> p.page_id then m.last end as refers_to
        from p left join m on p.d = m.d and p.b >= 1000""",
    "op4_decontamination": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        i as (select item_id, {_WORDS} as w from benchmark),
        iw as (select distinct item_id, case when len(w) < 13 then w else w[k : k + 12] end as win
               from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from i where len(w) > 0)),
        lens as (select distinct len(win) as n from iw),
        dw as (select doc_id, k, n, w[k : k + n - 1] as win
               from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, lens where len(w) >= n)),
        hit as (select dw.doc_id, dw.k, dw.n, iw.item_id from dw join iw on dw.win = iw.win),
        words as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from hit) group by doc_id),
        items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hit group by doc_id)
        select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
               cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
        from d left join words using (doc_id) left join items using (doc_id)""",
    "op5_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5""",
    # The given pages hold their main text in one article element, with these references at most.
    "op11_page_text": r"""
        with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') as a from pages),
        t as (select page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[a-z/!][^>]*>', ' ', 'g') as t from a),
        d as (select page_id, url, regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') as t from t),
        w as (select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) as text from d)
        select page_id, url, text, cast(length(text) as bigint) as n_chars from w""",
    "op12_conversations": rf"""
        with recursive crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
            lambda c, i: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end)) as table256),
        given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                  coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
        hit as (select * exclude (k, table256), xor({_CRC}, 4294967295) % 20 as kind from given, crc),
        hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                 case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
                 from (select *, unnest(case when kind = 3 then [1, 2] else [1] end) as copy from hit where kind <> 0)),
        numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from hurt),
        seen as (select *, row_number() over (partition by conv_id, role, text order by i) as nth,
                 right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last,
                 lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from numbered),
        turns as (select *, case when last = '' then 'blank' when nth > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault from seen),
        ins(p, n, st, added) as (values (0, 0, 0, []::varchar[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']),
            (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']), (2, 0, 2, []), (2, 1, 3, ['assistant:']),
            (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
        edits(e, st, initial, q, price, name) as (values ('D', 0, '', 0, 4, ''), ('D', 1, '', 1, 4, ''), ('D', 2, '', 2, 4, ''), ('D', 3, '', 3, 4, ''),
            ('K', 0, 's', 1, 0, ''), ('K', 0, 'u', 2, 0, ''), ('K', 1, 'u', 2, 0, ''), ('K', 3, 'u', 2, 0, ''), ('K', 2, 'a', 3, 0, ''),
            ('R', 0, '', 2, 3, 'user'), ('R', 1, '', 2, 3, 'user'), ('R', 3, '', 2, 3, 'user'), ('R', 2, '', 3, 3, 'assistant')),
        dp as (select distinct conv_id, 0::bigint as i, 0 as q, 0::bigint as cost, '' as audit, []::varchar[] as out from conversations
            union all
            select conv_id, i, q, cost, audit, out from (
                select t.conv_id, t.i, edits.q, d.cost + 3 * ins.n + edits.price + case when edits.e <> 'D' and fault = 'truncated' then 3 else 0 end as cost,
                       d.audit || repeat('I', ins.n) || edits.e as audit,
                       list_concat(d.out, list_concat(ins.added, case edits.e when 'D' then [] when 'K' then [t.role || ':' || t.text] else [edits.name || ':' || t.text] end)) as out,
                       row_number() over (partition by t.conv_id, edits.q order by d.cost + 3 * ins.n + edits.price + case when edits.e <> 'D' and fault = 'truncated' then 3 else 0 end,
                                          d.audit || repeat('I', ins.n) || edits.e) as rn
                from dp d join turns t on t.conv_id is not distinct from d.conv_id and t.i = d.i + 1
                join ins on ins.p = d.q join edits on edits.st = ins.st
                where edits.e = 'D' or (fault not in ('blank', 'duplicate') and (edits.e = 'R' or edits.initial = left(t.role, 1)))) x where rn = 1),
        counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
                   count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
                   count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from turns group by conv_id),
        all_counts as (select o.conv_id, coalesce(n, 0) as n, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
                       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal
                       from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id),
        ends as (select c.*, d.cost + 3 * ins.n as cost, d.audit || repeat('I', ins.n) as audit, list_concat(d.out, ins.added) as out
                 from all_counts c join dp d on d.conv_id is not distinct from c.conv_id and d.i = c.n join ins on ins.p = d.q where ins.st in (0, 3))
        select conv_id, cast(gaps as bigint) as gaps, cast(blank as bigint) as blank, cast(duplicate as bigint) as duplicate, cast(truncated as bigint) as truncated,
               cast(illegal as bigint) as illegal, cast(cost as bigint) as cost, audit, sha256(array_to_string(out, chr(10))) as repaired_sha256
        from (select *, row_number() over (partition by conv_id order by cost, audit) as rn from ends) where rn = 1""",
    "op13_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, c.vec_id, c.label = a.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score
              from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
        p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
              qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        n as (select p.*, s.vec_id as negative_id, s.score as negative_score,
              row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
              from p join s using (anchor_id) where not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
        select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10""",
}
