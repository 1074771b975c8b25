"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers

from tablewright.llm import alignment, bpe, chat, contamination, kmeans_tree, language, minhash, mixing, quality, substrings, suffixes, variants, wavelet


def _docs(spark, folder):
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def op1_minhash(spark, folder):
    return minhash.op1(_docs(spark, folder))


def op2_nearest_neighbours(spark, folder):
    return kmeans_tree.op2(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))


def op3_language_id(spark, folder):
    return language.op3(_docs(spark, folder))


def op4_substring_dedup(spark, folder):
    return substrings.op4(_docs(spark, folder))


def op5_bpe(spark, folder):
    return bpe.digests(_docs(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op6_chat_formatting(spark, folder):
    return chat.op6(spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet"))


def op7_suffix_dedup(spark, folder):
    return suffixes.op7(_docs(spark, folder))


def op8_mixing(spark, folder):
    return mixing.op8(_docs(spark, folder))


def op9_token_output(spark, folder):
    return wavelet.op9(_docs(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op10_quality_rules(spark, folder):
    return quality.op10(_docs(spark, folder))


def op11_alignment(spark, folder):
    return alignment.op11(_docs(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_decontamination(spark, folder):
    return contamination.op12(_docs(spark, folder), spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet"))


def op13_spelling_variants(spark, folder):
    return variants.op13(_docs(spark, folder))


def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_nearest_neighbours, op3_language_id, op4_substring_dedup, op5_bpe, op6_chat_formatting, op7_suffix_dedup, op8_mixing, op9_token_output, op10_quality_rules, op11_alignment, op12_decontamination, op13_spelling_variants, pipeline)}

def _turn(column: str) -> str:
    return f"replace(replace(coalesce({column}, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>')"


def _words_of(column: str) -> str:
    return f"list_filter(string_split_regex(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _crc_step(b: int) -> int:
    for _ in range(8):
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return b


#: Unsigned crc32 of the bytes of a string in hexadecimal digits.
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key), 2), lambda i: ('0x' || substr(key, i::bigint, 2))::bigint)), lambda a, b: xor(a >> 8, {[_crc_step(b) for b in range(256)]}[((xor(a, b) & 255) + 1)::int])), 4294967295::bigint)"""

#: Prefixes as whole strings, where the operator hashes them.
SQL: dict[str, str] = {
    "op6_chat_formatting": f"""
        with turns as (
            select conv_id, coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) as raw,
                   '<|im_start|>' || {_turn("role")} || chr(10) || {_turn("text")} || '<|im_end|>' || chr(10) as line,
                   row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i
            from conversations where conv_id is not null
        ), prefixes as (
            select conv_id, i, string_agg(raw, chr(3)) over (partition by conv_id order by i rows unbounded preceding) as prefix,
                   string_agg(line, '') over (partition by conv_id order by i rows unbounded preceding) as rendered,
                   max(i) over (partition by conv_id) as n
            from turns
        ), whole as (
            select min(conv_id) as conv_id, max(n) as n_turns, count(*) as n_copies, any_value(rendered) as rendered, prefix
            from prefixes where i = n group by prefix
        )
        select conv_id, n_turns, n_copies, rendered from whole
        where prefix not in (select prefix from prefixes where i < n)
    """,
    "op4_substring_dedup": """
        with texts as (
            select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents
        ), windows as (
            select doc_id, i, hash(list_slice(words, i, i + 49)) as h, md5(array_to_string(list_slice(words, i, i + 49), ' ')) as m
            from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from texts)
        ), firsts as (
            select h, m, min(doc_id) as owner from windows group by h, m
        ), gone as (
            select distinct doc_id, i + j as place
            from (select w.doc_id, w.i from windows w join firsts f using (h, m) where f.owner < w.doc_id), range(0, 50) r(j)
        ), placed as (
            select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from texts
        ), kept as (
            select doc_id, string_agg(word, ' ' order by place) as kept, count(*) as n
            from placed p where not exists (select 1 from gone g where g.doc_id = p.doc_id and g.place = p.place) group by doc_id
        )
        select t.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
        from texts t left join kept k using (doc_id)
    """,
    "op12_decontamination": f"""
        with texts as (
            select row_number() over () as r, doc_id, {_words_of("coalesce(text, '')")} as words from documents
        ), items as (
            select item_id, words, least(len(words), 10) as size from (select item_id, {_words_of("coalesce(text, '')")} as words from benchmark) where len(words) > 0
        ), windows as (
            select distinct item_id, size, array_to_string(list_slice(words, i, i + size - 1), ' ') as w
            from (select *, unnest(range(1, len(words) - size + 2)) as i from items)
        ), places as (
            select r, i, s.size, array_to_string(list_slice(words, i, i + s.size - 1), ' ') as w
            from (select distinct size from items) s, (select r, words, unnest(range(1, len(words) + 1)) as i from texts) t
            where i + s.size - 1 <= len(words)
        ), hits as (
            select r, i, p.size, item_id from places p join windows using (size, w)
        ), covered as (
            select r, count(distinct i + j) as n from (select distinct r, i, size from hits) h, range(0, 10) x(j) where j < size group by r
        ), named as (
            select r, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct r, item_id from hits) group by r
        )
        select doc_id, len(words)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
               sha256(coalesce(i.ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
        from texts left join covered c using (r) left join named i using (r)
    """,
    "op13_spelling_variants": f"""
        with recursive runs as (
            select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents
        ), counted as (
            select doc_id, run, count(*) as c from runs where length(run) >= 5 group by all
        ), hashed as (
            select run, c, {_CRC32} as h from (select *, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as key from counted)
        ), words as materialized (
            select word, sum(c)::bigint as n from (
                select c, case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from hashed
            ) where length(word) >= 5 group by word having sum(c) >= 3
        ), cut as (
            select word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) as holed, substr(word, 1, i - 1) || substr(word, i + 1) as without
            from (select word, n, unnest(range(1, length(word) + 1)) as i from words)
        ), near as (
            select a.word, a.n, b.word as other, b.n as m from cut a join cut b using (holed) where a.word <> b.word
            union select a.word, a.n, b.word, b.n from cut a join words b on a.without = b.word
            union select b.word, b.n, a.word, a.n from cut a join words b on a.without = b.word
        ), best as (
            select word, n, count(*) as n_near, max(m) as m, first(other order by m desc, other) as other from near group by word, n
        ), formed as materialized (
            select w.word, w.n, coalesce(b.n_near, 0)::bigint as n_near, case when b.m >= 2 * w.n then b.other end as form, case when b.m >= 2 * w.n then b.m end::bigint as form_n
            from words w left join best b using (word)
        ), paths as (
            select word, word as at from formed
            union all select p.word, f.form from paths p join formed f on f.word = p.at where f.form is not null
        ), ends as (
            select p.word, p.at as root from paths p join formed f on f.word = p.at where f.form is null
        )
        select word, form, root, n, n_near, form_n from formed join ends using (word)
    """,
}
