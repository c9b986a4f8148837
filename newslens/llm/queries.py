"""The registered queries of this package: each takes (session, table folder) and covers the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from newslens.llm import (
    bpe, chat, exact, infill, langid, mixing, resample, sharding, simhash, substrings, urls, vectors, warc,
)
from newslens.sources import storage

SHARDS = 24
WINDOW = 35
SHINGLE, DISTANCE = 3, 3
DRAWN_PERCENT, MIN_WORDS, NOISE_SEED = 10, 20, "2024"
FIM_RATE, SPM_RATE, FIM_SEED = 90, 20, "1"
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_formatting(spark, folder):
    """Prefix-target examples of all conversations, and what reading them back gives per conversation."""
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.expand(turns.unionByName(probe)))


def op2_mixing(spark, folder):
    """Place of every document in the mixture of its sources."""
    placed = mixing.mix(_table(spark, folder, "documents"))
    return placed.select("row.doc_id", "row.source", "stream", "block", "slot", "place")


def op3_sharding(spark, folder):
    """Shard and slot of every document: row counts at most one apart."""
    placed = sharding.shard(_table(spark, folder, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row", "position",
    )


def op4_simhash(spark, folder):
    """SimHash fingerprints and components of all documents."""
    found = simhash.near_duplicates(_table(spark, folder, "documents"), SHINGLE, DISTANCE)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_substrings(spark, folder):
    """Documents without the words of windows that occur again."""
    left = substrings.remove_repeats(_table(spark, folder, "documents"), WINDOW, F.sha2("kept", 256))
    return left.withColumnRenamed("kept", "kept_sha256")


def op6_exact_dedup(spark, folder):
    """Exact duplicates of all documents, by way of a digest index."""
    index = exact.open_index(spark)
    found = exact.classify(_table(spark, folder, "documents"), index)
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_bpe(spark, folder):
    """Token counts and digests of all documents."""
    return bpe.encode(_table(spark, folder, "documents"), bpe.tokenizer_file(spark, TOKENIZER), ids=False)


def op8_language_id(spark, folder):
    """Languages of all documents, learnt from four fifths of them."""
    docs = _table(spark, folder, "documents")
    fold = langid.fold(F.col("doc_id"))
    model = langid.fit(docs, (fold != 0) & (fold != 1), fold == 1)
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select(
        "doc_id", F.coalesce(langid.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected",
    )


def op9_warc(spark, folder):
    """All pages through WARC archives and their merged index."""
    entries = warc.archive(_table(spark, folder, "pages"), storage.scratch_folder(spark, "warc"))
    return entries.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_embeddings(spark, folder):
    """Links and components of all embeddings."""
    return vectors.near_duplicates(_table(spark, folder, "embeddings"))


def op11_resampling(spark, folder):
    """Weights of all documents towards the benchmark, and the ranks of those drawn."""
    docs, target = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return resample.resample(docs, target, DRAWN_PERCENT, MIN_WORDS, seed=NOISE_SEED)


def op12_fill_in_middle(spark, folder):
    """Fill-in-middle examples of all documents, and the texts rebuilt from them."""
    cut = infill.transform(_table(spark, folder, "documents"), FIM_RATE, SPM_RATE, seed=FIM_SEED)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_url_filter(spark, folder):
    """Verdicts on the URLs of all pages, by rules or by trees trained on hosts that a list of words labels."""
    pages = _table(spark, folder, "pages")
    return urls.judge(pages, urls.fit(urls.seeded(pages)), URL_RULES)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries of this module by name."""
    return {name: f for name, f in globals().items() if name.startswith("op")}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ESCAPED = """regexp_replace(regexp_replace({0}, '<(\\\\*)(s>|/s>|\\|>)', '<\\\\\\1\\2', 'g'), '\\[(\\\\*)(INST\\]|/INST\\])', '[\\\\\\1\\2', 'g')"""


def statements() -> dict[str, str]:
    """The same results in DuckDB's SQL, where it can express them."""
    return {
        "op1_chat_formatting": f"""
            with turns as (
                select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
                union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
            sized as (
                select *, length('<s>' || {_ESCAPED.format('role')} || '<|>' || {_ESCAPED.format('text')} || '</s>') as n,
                    row_number() over (partition by conv_id order by turn nulls first, role, text) as nr,
                    count(*) over (partition by conv_id) as last
                from turns),
            prefixed as (
                select *, sum(n) over (partition by conv_id order by nr) as prefix from sized)
            select conv_id, count(*) as n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' order by nr)) as turns_sha256,
                cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
                sha256(coalesce(string_agg(text, '' order by nr) filter (role = 'assistant'), '')) as loss_sha256,
                cast(sum(prefix) filter (role = 'assistant' or nr = last) as bigint) as formatted_chars,
                count(*) filter (role = 'assistant') as n_examples
            from prefixed group by conv_id""",
        "op5_substrings": f"""
            with split as (
                select row_number() over () as r, doc_id,
                    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
                from documents),
            windows as (
                select r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') as win
                from split, unnest(range(1, len(w) - {WINDOW - 2})) as t(i)),
            twice as (
                select r, i from (select r, i, count(*) over (partition by win) as n from windows) where n > 1),
            covered as (
                select distinct r, i + j as i from twice, unnest(range(0, {WINDOW})) as t(j)),
            gone as (select r, list(i) as gone, count(*) as n from covered group by r)
            select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed,
                sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' ')) as kept_sha256
            from split left join gone using (r)""",
        "op6_exact_dedup": f"""
            with normal as (select doc_id, {_LOWER} as t from documents)
            select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
                coalesce(doc_id = max(doc_id) over same, false)
                    and row_number() over (partition by t, doc_id) = 1 as kept,
                sha256(t) as text_sha256
            from normal window same as (partition by t)""",
        "op9_warc": """
            with payloads as (
                select page_id, coalesce(html, '') as p, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
            firsts as (select *, min(page_id) over (partition by p) as first from payloads)
            select page_id, payload_bytes, sha256(p) as payload_digest,
                case when payload_bytes >= 100 and page_id is distinct from first then 'revisit' else 'response' end as record_type,
                case when payload_bytes >= 100 and page_id is distinct from first then first end as refers_to
            from firsts""",
        "op11_resampling": f"""
            with split as (
                select r, doc_id, word from (
                    select row_number() over () as r, doc_id,
                        regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents)
                left join lateral (select unnest(w) as word) on true),
            wanted as (
                select unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from benchmark),
            kinds as (
                select word, hex(encode(word)) as h from (select word from split where word is not null union select word from wanted)),
            hashed as (
                select word, xor(4294967295, list_reduce(
                    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)),
                        lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end))) % 10000 as bucket
                from kinds),
            held as (select bucket, count(*) as s from split join hashed using (word) group by bucket),
            asked as (select bucket, count(*) as t from wanted join hashed using (word) group by bucket),
            sums as (select (select coalesce(sum(s), 0) from held) as s_all, (select coalesce(sum(t), 0) from asked) as t_all),
            gain as (
                select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE
                    / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT as g
                from held left join asked using (bucket), sums),
            weighted as (
                select r, any_value(doc_id) as doc_id, count(word) as n_features,
                    coalesce(floor(sum(g)::DOUBLE / count(word)), 0)::BIGINT as weight
                from split left join hashed using (word) left join gain using (bucket) group by r),
            scored as (
                select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{NOISE_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                    + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT as score
                from weighted),
            placed as (
                select r, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as n
                from scored where n_features >= {MIN_WORDS})
            select doc_id, n_features, weight, score, case when place <= {DRAWN_PERCENT} * n // 100 then place end as rank
            from scored left join placed using (r)""",
        "op12_fill_in_middle": f"""
            with hashed as (
                select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::BIGINT as n,
                    sha256('{FIM_SEED}:' || coalesce(doc_id::VARCHAR, '')) as d from documents),
            drawn as (
                select *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) as a, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) as b,
                    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
                        or ('0x' || substr(d, 17, 8))::BIGINT % 100 >= {FIM_RATE} then 'plain'
                    when ('0x' || substr(d, 25, 8))::BIGINT % 100 < {SPM_RATE} then 'spm' else 'psm' end as form
                from hashed),
            parts as (
                select *, substr(t, 1, least(a, b)) as p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) as m,
                    substr(t, greatest(a, b) + 1) as s
                from drawn)
            select doc_id, n, form, case when form <> 'plain' then least(a, b) end as prefix_chars,
                case when form <> 'plain' then greatest(a, b) - least(a, b) end as middle_chars,
                sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                    when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else t end) as output_sha256,
                sha256(t) as restored_sha256
            from parts""",
        "op10_embeddings": """
            with recursive vectors as (
                select vec_id, label, cast(embedding as double[]) as e from embeddings
                where label is not null and embedding is not null
                    and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
                    and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
            links as (
                select a.vec_id as a, b.vec_id as b from vectors a join vectors b
                on a.label = b.label and a.vec_id <> b.vec_id
                where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
            reach as (
                select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
            least as (select a, min(b) as low from reach group by a),
            degrees as (select a, count(*) as n from links group by a)
            select vec_id, coalesce(n, 0) as n_links, coalesce(least(low, vec_id), vec_id) as component_id,
                coalesce(low, vec_id) >= vec_id as kept
            from embeddings left join least on vec_id = least.a left join degrees on vec_id = degrees.a""",
    }
