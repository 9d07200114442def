"""Named queries of the training-data operators: each runs over its whole table."""

from __future__ import annotations

from martlight.llm.bpe import encode_decode_digest
from martlight.llm.common import table
from martlight.llm.exact_dedup import duplicates
from martlight.llm.hard_negatives import mine_embeddings
from martlight.llm.html import extract_pages
from martlight.llm.neighbours import search_embeddings
from martlight.llm.packing import pack
from martlight.llm.quality import score_documents
from martlight.llm.repair import repair_conversations
from martlight.llm.rules import judge_documents
from martlight.llm.sharding import shard_documents
from martlight.llm.simhash import fingerprint_documents
from martlight.llm.token_counts import LIMITS, histogram, lengths, suffix_sums
from martlight.llm.warc import archive_pages
from martlight.session import tune

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def _on(name: str, operator):
    return lambda spark, folder: operator(table(tune(spark), folder, name))


QUERIES = {
    "op1_bpe": _on("documents", lambda d: encode_decode_digest(d, WORD_VOCABULARY)),
    "op2_sharding": _on("documents", shard_documents),
    "op3_quality": lambda spark, folder: score_documents(
        table(tune(spark), folder, "documents"), table(spark, folder, "labels")
    ),
    "op4_neighbours": _on("embeddings", search_embeddings),
    "op5_packing": _on("documents", lambda d: pack(d, BYTE_VOCABULARY)),
    "op6_html": _on("pages", extract_pages),
    "op7_token_counts": _on("documents", lambda d: suffix_sums(histogram(lengths(d, BYTE_VOCABULARY)), LIMITS)),
    "op8_simhash": _on("documents", fingerprint_documents),
    "op9_warc": _on("pages", archive_pages),
    "op10_exact_dedup": _on("documents", duplicates),
    "op11_rules": _on("documents", judge_documents),
    "op12_hard_negatives": _on("embeddings", mine_embeddings),
    "op13_repair": _on("conversations", repair_conversations),
}

ORACLES = {
    "op9_warc": """
        with p as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
            from pages
        ), f as (
            select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest
        )
        select p.page_id, p.payload_bytes, p.payload_digest,
            case when f.first < p.page_id then 'revisit' else 'response' end as record_type,
            case when f.first < p.page_id then f.first end as refers_to
        from p left join f using (payload_digest)
    """,
    "op10_exact_dedup": """
        with d as (
            select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
            from documents
        ), g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.t) as text_sha256
        from d join g using (t)
    """,
    "op11_rules": r"""
        with d as (
            select row_number() over () as r, doc_id, coalesce(text, '') as t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
            from documents
        ), windows as (
            select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n
            from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)
        ), covered as (
            select r, count(distinct i + k) as n_repeat_words
            from windows, (values (0), (1), (2)) as o(k) where n > 1 group by r
        ), m as (
            select d.doc_id, cast(len(w) as bigint) as n_words,
                cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
                cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
                cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
                cast(len(l) as bigint) as n_lines,
                cast(len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) as bigint) as n_letter_words
            from d left join covered using (r)
        ), f as (
            select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint
                + 4 * (10 * n_symbols > n_words)::bigint + 8 * (word_chars < 3 * n_words)::bigint
                + 16 * (word_chars > 10 * n_words)::bigint + 32 * (100 * n_letter_words < 80 * n_words)::bigint
                + 64 * (100 * n_dup_lines > 50 * n_lines)::bigint + 128 * (n_words > 100000)::bigint as failed
            from m
        )
        select *, failed & 127 = 0 as kept, 2::integer as policy, failed & 3 <> 0 as base_failed from f
    """,
    "op12_hard_negatives": """
        with e as (
            select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select a.id as anchor_id, b.id as other_id, a.label = b.label as same,
                cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
            from e a join e b on a.id % 50 = 0 and a.id <> b.id and len(a.v) = len(b.v)
        ), p as (
            select anchor_id, other_id as positive_id, score as positive_score from s where same
            qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
        )
        select anchor_id, positive_id, cast(row_number() over w as integer) as rank, other_id as negative_id,
            positive_score, score as negative_score
        from p join s using (anchor_id)
        where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
        window w as (partition by anchor_id, positive_id order by score desc, other_id)
        qualify rank <= 3
    """,
}
