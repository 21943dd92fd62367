"""Registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmetrics.llm import bpe_stream, chat, collocations, decontamination, divergence, minhash, nearest, pii, repeats, secret_scan, sentencepiece_bpe, sharding, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; pass another path to the operators to use another."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def counts(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    return [F.size(of_kinds(spans, (kind,))).cast("long").alias(f"n_{kind}") for kind in kinds]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, machine).select(
        "doc_id",
        F.coalesce(~toxicity.in_training(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    return pii.find_pii(table(spark, sf_dir, "documents")).select(
        "doc_id", *counts(spans, pii.BASE), digest(spelled(of_kinds(spans, pii.BASE))).alias("base_sha256"), spelled(spans).alias("spans")
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra), vocabulary("byte_bpe_50k.json")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = secret_scan.KINDS[:3]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    return secret_scan.scan_secrets(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *counts(spans, base),
        digest(spelled(of_kinds(spans, base))).alias("base_sha256"),
        spelled(spans).alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("n_words"),
        F.col("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        digest(F.array_join("items", ",")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.token_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash,
        op2_toxicity,
        op3_suffix_array,
        op4_nearest,
        op5_sentencepiece,
        op6_pii,
        op7_chat,
        op8_secrets,
        op9_decontamination,
        op10_sharding,
        op11_bpe,
        op12_collocations,
        op13_divergence,
    )
}
#: Where SQL can say what an operator finds; all are held against a brute-force version in tests/llm besides.
SQL: dict[str, str] = {
    "op1_minhash": r"""
        with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        shingles as (select distinct doc_id, unnest(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
            else w end) as s from words),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id group by all),
        links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        ways as (select a, b from links union all select b, a from links),
        reached as (select a, b from ways union select r.a, w.b from reached r join ways w on w.a = r.b),
        smallest as (select a as doc_id, min(b) as b from reached group by a)
        select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(b, doc_id)) as component_id, doc_id <= coalesce(b, doc_id) as kept
        from words left join sizes using (doc_id) left join smallest using (doc_id)""",
    "op7_chat": r"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        marked as (select *, replace(replace(role, '\', '\\'), '<|', '<\|') as r, replace(replace(text, '\', '\\'), '<|', '<\|') as t from turns)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
            cast(sum(length('<|start|>' || r || '<|text|>' || t || '<|end|>')) as bigint) as formatted_chars
        from marked group by conv_id""",
    "op9_decontamination": r"""
        with docs as (select row_number() over () as id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        items as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        starts as (select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from items where len(w) > 0),
        windows as (select distinct item_id, size, array_to_string(w[i:i + size - 1], ' ') as x from starts),
        sizes as (select distinct size from windows),
        spots as (select id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size),
        found as (select id, size, i, array_to_string(w[i:i + size - 1], ' ') as x from spots),
        hits as (select id, i, f.size, item_id from found f join windows using (size, x)),
        covered as (select id, count(distinct p) as n from (select id, unnest(range(i, i + size)) as p from hits) group by id),
        named as (select id, list_sort(list(distinct cast(item_id as varchar))) as ids from hits where item_id is not null group by id)
        select doc_id, len(w) as n_words, coalesce(n, 0) as n_hit, coalesce(len(ids), 0) as n_items,
            sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n, 0) > 0 as contaminated
        from docs left join covered using (id) left join named using (id)""",
    "op12_collocations": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        parts as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
        spots as (select lang, w, unnest(range(1, len(w) + 1)) as i from parts),
        found as (
            select lang, 1 as size, w[i] as phrase from spots
            union all select lang, 2, w[i] || ' ' || w[i + 1] from spots where i + 1 <= len(w)
            union all select lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from spots where i + 2 <= len(w)),
        counts as (select lang, size, phrase, count(*) as n from found group by all),
        totals as (select lang, cast(sum(n) as bigint) as n from counts where size = 1 group by lang),
        candidates as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from counts where size > 1 and n >= 10),
        cuts as (select *, unnest(range(1, size)) as k from candidates),
        sides as (select *, array_to_string(w[:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest from cuts),
        scored as (
            select s.lang, s.phrase, s.a, x.n as l, y.n as r,
                cast(1000000::hugeint * s.a * s.a // (x.n::hugeint * y.n) as bigint) as score
            from sides s join counts x on x.lang = s.lang and x.phrase = s.first join counts y on y.lang = s.lang and y.phrase = s.rest
            qualify row_number() over (partition by s.lang, s.phrase order by 1000000::hugeint * s.a * s.a // (x.n::hugeint * y.n), s.k) = 1),
        longer as (
            select lang, phrase, max(a) as a from (
                select lang, array_to_string(w[:2], ' ') as phrase, a from candidates where size = 3
                union all select lang, array_to_string(w[2:], ' '), a from candidates where size = 3) group by all),
        kept as (select s.* from scored s left join longer o using (lang, phrase) where o.a is null or 100 * o.a < 50 * s.a)
        select lang, row_number() over (partition by lang order by score desc, k.a desc, encode(phrase)) as rank, phrase, k.a, l, r, t.n, score
        from kept k join totals t using (lang) qualify rank <= 2000""",
    "op13_divergence": r"""
        with docs as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source
            from documents),
        words as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
        terms as (select lang, term, count(*) as n from words group by all having count(distinct id) >= 3),
        counts as (select w.lang, w.source, w.term, count(*) as n from words w join terms using (lang, term) group by all),
        langs as (select lang, count(*) as v, sum(n) as total from terms group by lang),
        groups as (select d.lang, d.source, coalesce(sum(c.n), 0) as total from (select distinct lang, source from docs) d
            left join counts c on c.lang = d.lang and c.source = d.source group by all),
        shares as (
            select g.lang, g.source, t.term, coalesce(c.n, 0) as n,
                1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.total + l.v) as p, 1 + 1000000000::hugeint * (t.n + 1) // (l.total + l.v) as q
            from groups g join langs l on l.lang = g.lang join terms t on t.lang = g.lang
            left join counts c on c.lang = g.lang and c.source = g.source and c.term = t.term),
        pairs as (select x.lang, x.source, 'pair' as part, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
            from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all),
        none as (select x.lang, x.source, 'pair' as part, y.source as item, 0 as value from groups x join groups y
            on x.lang = y.lang and x.source <> y.source where x.lang not in (select lang from langs)),
        own as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from shares where n > 0 and p > q),
        every as (select * from pairs union all select * from none union all select * from own)
        select lang, source, part, item, cast(value as bigint) as value,
            cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
        from every qualify part = 'pair' or rank <= 200""",
}
