"""Text and binary functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import binary, strings
from tablewright.plans.registry import query

# Base letters of the accented letters that occur in the four languages.
ACCENTS = {
    "à": "a", "â": "a", "ä": "a", "á": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "í": "i", "î": "i", "ï": "i",
    "ñ": "n", "ó": "o", "ô": "o", "ö": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ß": "ss", "œ": "oe", "æ": "ae",
    "É": "E", "È": "E", "Ê": "E", "À": "A", "Ç": "C", "Ä": "A", "Ö": "O", "Ü": "U", "Ñ": "N", "Ó": "O", "Á": "A", "Í": "I", "Ú": "U",
}


@query(
    "text_case_pad_trim", "2.9.1 2.9.2 2.9.4 2.9.5 2.9.6 2.9.7 2.9.8 2.9.9 2.9.10 2.9.11",
    """
    SELECT p_partkey, lower(p_type) AS lo, upper(p_name) AS up, lpad(p_brand, 10, '*') AS lp, lpad(p_name, 4, 'xy') AS cut,
           rpad(p_brand, 10, 'ab') AS rp, trim(p_name, 'sremd') AS bt, ltrim(p_name, 'sremd') AS lt, rtrim(p_name, 'tr') AS rt,
           replace(translate(p_name, 'abc', 'xyz'), 'o', '') AS tr, ascii(p_name)::INTEGER AS code, repeat(p_type, p_size % 3) AS rep
    FROM part
    """,
)
def text_case_pad_trim(t):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t.part.select(
        "p_partkey", F.lower(kind).alias("lo"), F.upper(name).alias("up"), F.lpad(brand, 10, "*").alias("lp"),
        F.lpad(name, 4, "xy").alias("cut"), F.rpad(brand, 10, "ab").alias("rp"), F.btrim(name, F.lit("sremd")).alias("bt"),
        F.ltrim(name, F.lit("sremd")).alias("lt"), F.rtrim(name, F.lit("tr")).alias("rt"),
        F.translate(name, "abco", "xyz").alias("tr"), F.ascii(name).alias("code"), F.repeat(kind, F.col("p_size") % 3).alias("rep"),
    )


@query(
    "text_initcap", "2.9.3",
    r"""
    SELECT page_id, (SELECT string_agg(upper(p[1]) || substr(p, 2), '' ORDER BY i) FROM
      (SELECT unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT regexp_extract_all(lower(url), '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)') AS x))) AS title
    FROM pages
    """,
)
def text_initcap(t):
    return t.pages.select("page_id", strings.initcap_words(F.col("url")).alias("title"))


@query(
    "text_parts", "2.9.12 2.9.13 2.9.14 2.9.16 2.9.17 2.9.18 2.9.19 2.9.20 2.9.21 2.9.29",
    """
    SELECT doc_id, chr((200 + doc_id % 5000)::INTEGER) AS ch, octet_length(encode(text))::INTEGER AS bytes, bit_length(text)::INTEGER AS bits,
           length(text)::INTEGER AS chars, substr(text, 3, 12) AS mid, strpos(text, 'the')::INTEGER AS pos,
           substr(text, 1, 1) || '##' || substr(text, 4) AS laid, md5(replace(text, 'e', '3')) AS swapped,
           split_part(text, ' ', 4) AS fourth, printf('%x', doc_id + 255) AS hexed, md5(text) AS digest
    FROM documents
    """,
)
def text_parts(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", strings.chr_code(F.col("doc_id") % 5000 + 200).alias("ch"), F.octet_length(text).alias("bytes"), F.bit_length(text).alias("bits"),
        F.length(text).alias("chars"), F.substring(text, 3, 12).alias("mid"), F.instr(text, "the").alias("pos"),
        F.overlay(text, F.lit("##"), F.lit(2), F.lit(2)).alias("laid"), F.md5(F.replace(text, F.lit("e"), F.lit("3"))).alias("swapped"),
        F.split_part(text, F.lit(" "), F.lit(4)).alias("fourth"), F.lower(F.hex(F.col("doc_id") + 255)).alias("hexed"), F.md5(text).alias("digest"),
    )


@query(
    "text_join_slice", "2.9.22 2.9.23 2.9.24 2.9.43",
    """
    SELECT c_custkey, reverse(c_name) AS rev, c_name[1:4] AS l4, c_name[1:length(c_name)-3] AS lneg, right(c_name, 5) AS r5,
           substr(c_name, 10) AS rneg, concat(c_name, NULL, '-', c_nationkey) AS cat, concat_ws('/', c_mktsegment, nullif(c_nationkey, 3), 'x') AS ws,
           c_name || ':' || c_mktsegment AS piped, rtrim(rpad(c_mktsegment, 12, ' ')) = rtrim(c_mktsegment || '  ') AS padded_eq
    FROM customer
    """,
)
def text_join_slice(t):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    key = F.col("c_nationkey").cast("string")
    return t.customer.select(
        "c_custkey", F.reverse(name).alias("rev"), strings.left(name, 4).alias("l4"), strings.left(name, -3).alias("lneg"),
        strings.right(name, 5).alias("r5"), strings.right(name, -9).alias("rneg"),
        strings.concat_skip(name, F.lit(None).cast("string"), F.lit("-"), key).alias("cat"),
        F.concat_ws("/", seg, F.nullif(F.col("c_nationkey"), F.lit(3)).cast("string"), F.lit("x")).alias("ws"),
        F.concat(name, F.lit(":"), seg).alias("piped"), strings.padded_equal(F.rpad(seg, 12, " "), F.concat(seg, F.lit("  "))).alias("padded_eq"),
    )


@query(
    "text_format_quote", "2.9.25 2.9.30",
    """
    SELECT p_partkey, 'part ' || p_name || ' in "' || p_type || '" is ' || CASE WHEN p_size > 25 THEN '''' || p_brand || '''' ELSE 'NULL' END || ' 100%' AS f,
           '''' || replace(p_name, 'o', '''''') || '''' AS ql, CASE WHEN p_size > 25 THEN '''' || p_brand || '''' ELSE 'NULL' END AS qn,
           p_type || '.' || p_name || '.' || p_type AS positional FROM part
    """,
)
def text_format_quote(t):
    maybe = F.when(F.col("p_size") > 25, F.col("p_brand"))
    return t.part.select(
        "p_partkey", strings.format_text("part %s in %I is %L 100%%", F.col("p_name"), F.col("p_type"), maybe).alias("f"),
        strings.quote_literal(F.replace("p_name", F.lit("o"), F.lit("'"))).alias("ql"), strings.quote_nullable(maybe).alias("qn"),
        strings.format_text("%2$s.%1$s.%2$s", F.col("p_name"), F.col("p_type")).alias("positional"),
    )


@query(
    "text_regex", "2.9.15 2.9.26 2.9.27 2.9.28",
    r"""
    SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host, array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS numbers,
           regexp_replace(url, '[aeiou]+', '_') AS first_only, regexp_replace(url, '[aeiou]+', '<\0>', 'g') AS every,
           array_to_string(regexp_split_to_array(url, '[/.]+'), '|') AS split,
           CASE WHEN url LIKE 'http%example.___/%' THEN regexp_extract(url, '^http.*example\.(...)/.*$', 1) END AS tld
    FROM pages
    """,
)
def text_regex(t):
    url = F.col("url")
    return t.pages.select(
        "page_id", F.regexp_extract(url, "^https?://([^/]*)", 1).alias("host"),
        F.array_join(F.regexp_extract_all(url, F.lit("([0-9]+)"), 1), ",").alias("numbers"),
        strings.replace_first(url, "[aeiou]+", "_").alias("first_only"), strings.replace_first(url, "[aeiou]+", "<$0>", "g").alias("every"),
        F.array_join(F.split(url, "[/.]+"), "|").alias("split"),
        strings.substring_similar(url, 'http%example.#"___#"/%').alias("tld"),
    )


@query(
    "regex_matches_rows", "2.9.26",
    r"""
    SELECT doc_id, m[1] AS word, m[2] AS next, count(*) AS n FROM (
      SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '(\w+)@(\w+)', 1), regexp_extract_all(text, '(\w+)@(\w+)', 2))) AS m FROM documents) GROUP BY ALL
    """,
)
def regex_matches_rows(t):
    p = F.lit(r"(\w+)@(\w+)")
    pairs = F.arrays_zip(F.regexp_extract_all("text", p, F.lit(1)).alias("a"), F.regexp_extract_all("text", p, F.lit(2)).alias("b"))
    return t.documents.select("doc_id", F.explode(pairs).alias("m")).groupBy("doc_id", F.col("m.a").alias("word"), F.col("m.b").alias("next")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "binary_encodings", "2.9.31 2.9.32 2.9.44",
    """
    SELECT doc_id, md5(lower(hex(encode(text)))) AS hx, md5(to_base64(encode(text))) AS b64, md5(text) AS back,
           lower(hex(encode(text))[5:24]) AS cut, md5(lower(hex(encode('Z' || s || 'ZZ')))) AS wide, md5(lower(hex(encode(s)))) AS trimmed,
           CASE WHEN strpos(s, 'e') > 0 THEN octet_length(encode(s[1:strpos(s, 'e')]))::INTEGER ELSE 0 END AS at
    FROM (SELECT *, trim(text, 'Z') AS s FROM documents)
    """,
)
def binary_encodings(t):
    s = F.btrim("text", F.lit("Z"))
    raw = F.encode(F.col("text"), "UTF-8")
    wide = F.concat(F.lit(b"Z"), F.encode(s, "UTF-8"), F.lit(b"ZZ"))
    return t.documents.select(
        "doc_id", F.md5(F.lower(F.hex(raw))).alias("hx"), F.md5(F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))).alias("b64"),
        F.md5(F.decode(F.unbase64(F.base64(raw)), "UTF-8")).alias("back"),
        F.lower(F.hex(F.substring(raw, 3, 10))).alias("cut"),
        F.md5(F.lower(F.hex(wide))).alias("wide"), F.md5(F.lower(F.hex(binary.trim(wide, b"Z")))).alias("trimmed"),
        binary.position(F.encode(s, "UTF-8"), b"e").alias("at"),
    )


@query(
    "weighted_edit_distance", "2.9.33",
    """
    SELECT DISTINCT p_name, levenshtein(p_name, 'red bolt')::INTEGER AS d, CASE WHEN levenshtein(p_name, 'red bolt') <= 4 THEN levenshtein(p_name, 'red bolt')::INTEGER ELSE -1 END AS bounded,
           2 * levenshtein(p_name, 'red bolt')::INTEGER AS double_cost FROM part
    """,
)
def weighted_edit_distance(t):
    d = t.part.select("p_name").distinct()
    return d.select("p_name", F.levenshtein("p_name", F.lit("red bolt")).alias("d"), F.levenshtein("p_name", F.lit("red bolt"), 4).alias("bounded"),
                    strings.edit_cost(F.col("p_name"), F.lit("red bolt"), 2, 2, 2).alias("double_cost"))


@query(
    "trigram_similarity", "2.9.36",
    r"""
    WITH txts AS (SELECT DISTINCT p_name AS txt FROM part),
    toks AS (SELECT DISTINCT txt, unnest(string_split(txt, ' ')) AS w FROM txts),
    g AS (SELECT DISTINCT txt, substr('  ' || w || ' ', i::BIGINT, 3) AS g FROM toks, LATERAL (SELECT unnest(range(1, length(w) + 2)) AS i)),
    q AS (SELECT unnest(['  r', ' re', 'red', 'ed ', '  b', ' bo', 'bol', 'olt', 'lt ']) AS g),
    s AS (SELECT txt, count(*) AS n, count(q.g) AS shared FROM g LEFT JOIN q ON g.g = q.g GROUP BY txt)
    SELECT txt, n::INTEGER AS grams, round(shared / (9 + n - shared), 6) AS sim, round(1 - shared / (9 + n - shared), 6) AS dist FROM s
    """,
)
def trigram_similarity(t):
    q = F.lit("red bolt")
    sim = strings.similarity(F.col("txt"), q)
    return t.part.select(F.col("p_name").alias("txt")).distinct().select(
        "txt", F.size(strings.trigrams(F.col("txt"))).alias("grams"), F.round(sim, 6).alias("sim"), F.round(1 - sim, 6).alias("dist")
    )


@query(
    "word_similarity", "2.9.36",
    r"""
    WITH txts AS (SELECT DISTINCT regexp_extract(html, '<title>([^<]*)</title>', 1) AS txt FROM pages),
    w AS (SELECT txt, unnest(list_filter(regexp_split_to_array(lower(txt), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(lower(txt), '[^\p{L}\p{N}]+'), lambda x: x <> ''), 1) AS n FROM txts),
    g AS (SELECT txt, row_number() OVER (PARTITION BY txt ORDER BY n, i) AS p, substr('  ' || w || ' ', i, 3) AS g FROM w, LATERAL (SELECT unnest(range(1, length(w) + 2)) AS i)),
    s AS (SELECT txt, list(g ORDER BY p) AS gs FROM g GROUP BY txt),
    q AS (SELECT ['  t', ' th', 'the', 'her', 'ere', 're '] AS q),
    r AS (SELECT txt, q, list_distinct(gs[a:b]) AS part FROM s, q, LATERAL (SELECT unnest(range(1, len(gs) + 1)) AS a), LATERAL (SELECT unnest(range(a, len(gs) + 1)) AS b)),
    m AS (SELECT txt, max(len(list_intersect(part, q)) / (6 + len(part) - len(list_intersect(part, q)))) AS sim FROM r GROUP BY txt)
    SELECT page_id, round(coalesce(sim, 0), 9) AS sim FROM pages LEFT JOIN m ON txt = regexp_extract(html, '<title>([^<]*)</title>', 1)
    """,
)
def word_similarity(t):
    title = t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("txt"))
    return title.select("page_id", F.round(strings.word_similarity(F.lit("there"), F.col("txt")), 9).alias("sim"))


@query(
    "unaccent_text", "2.9.37",
    "SELECT doc_id, md5("
    + "".join("replace(" for _ in ACCENTS) + "text" + "".join(f", '{k}', '{v}')" for k, v in ACCENTS.items())
    + ") AS folded FROM documents",
)
def unaccent_text(t):
    return t.documents.select("doc_id", F.md5(strings.unaccent(F.col("text"), ACCENTS)).alias("folded"))


@query(
    "column_hashing", "2.9.38",
    """
    SELECT c_custkey, sha256(c_name) AS sha256, sha1(c_name) AS sha1, md5(c_name) AS md5,
           sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode(c_name)))) AS hmac FROM customer
    """.format(
        o=bytes(b ^ 0x5C for b in b"secret key".ljust(64, b"\0")).hex(), i=bytes(b ^ 0x36 for b in b"secret key".ljust(64, b"\0")).hex()
    ),
)
def column_hashing(t):
    name = F.col("c_name")
    return t.customer.select(
        "c_custkey", F.sha2(name, 256).alias("sha256"), F.sha1(name).alias("sha1"), F.md5(name).alias("md5"),
        strings.hmac_sha256(name, b"secret key").alias("hmac"),
    )


@query("column_encryption", "2.9.39", "SELECT c_custkey, c_name AS back, true AS hidden FROM customer")
def column_encryption(t):
    key = F.lit(b"0123456789abcdef")
    secret = F.aes_encrypt("c_name", key, F.lit("CBC"), F.lit("PKCS"))
    return t.customer.select("c_custkey", secret.alias("s"), "c_name").select(
        "c_custkey", F.aes_decrypt("s", key, F.lit("CBC"), F.lit("PKCS")).cast("string").alias("back"),
        (F.hex("s") != F.hex(F.col("c_name").cast("binary"))).alias("hidden"),
    )


@query(
    "identifier_check_digits", "2.9.40",
    """
    WITH d AS (SELECT o_orderkey, lpad((978000000000 + o_orderkey * 977)::VARCHAR, 12, '0') AS e, lpad((o_orderkey * 13)::VARCHAR, 9, '0') AS b,
                      lpad((o_orderkey * 7)::VARCHAR, 7, '0') AS s FROM orders)
    SELECT o_orderkey,
      ((10 - (list_sum([substr(e, i, 1)::INTEGER * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END) FOR i IN range(1, 13)]) % 10)) % 10)::INTEGER AS ean13,
      CASE (11 - list_sum([substr(b, i, 1)::INTEGER * (11 - i) FOR i IN range(1, 10)]) % 11) % 11 WHEN 10 THEN 'X'
        ELSE ((11 - list_sum([substr(b, i, 1)::INTEGER * (11 - i) FOR i IN range(1, 10)]) % 11) % 11)::INTEGER::VARCHAR END AS isbn10,
      CASE (11 - list_sum([substr(s, i, 1)::INTEGER * (9 - i) FOR i IN range(1, 8)]) % 11) % 11 WHEN 10 THEN 'X'
        ELSE ((11 - list_sum([substr(s, i, 1)::INTEGER * (9 - i) FOR i IN range(1, 8)]) % 11) % 11)::INTEGER::VARCHAR END AS issn
    FROM d
    """,
)
def identifier_check_digits(t):
    key = F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", strings.check_digit_ean13(F.lpad((key * 977 + 978000000000).cast("string"), 12, "0")).alias("ean13"),
        strings.check_char_isbn10(F.lpad((key * 13).cast("string"), 9, "0")).alias("isbn10"),
        strings.check_char_issn(F.lpad((key * 7).cast("string"), 7, "0")).alias("issn"),
    )


@query(
    "uuid_named", "2.9.41",
    """
    SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
           || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS v5,
           substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-'
           || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(m, 17, 1)), 1) || substr(m, 18, 3) || '-' || substr(m, 21, 12) AS v3
    FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h, md5(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS m FROM pages)
    """,
)
def uuid_named(t):
    url = F.col("url")
    return t.pages.select("page_id", strings.uuid_named(url).alias("v5"), strings.uuid_named(url, version=3).alias("v3"))


@query(
    "enum_order", "2.9.42",
    """
    SELECT o_orderstatus, ord::INTEGER AS ord, ord < 2 AS before_last, n, 'P' AS first, 'F' AS last, 'O,F' AS from_open
    FROM (SELECT o_orderstatus, strpos('POF', o_orderstatus) - 1 AS ord, count(*) AS n FROM orders GROUP BY ALL)
    """,
)
def enum_order(t):
    status = strings.Enum("P", "O", "F")
    return t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(
        "o_orderstatus", status.ordinal(F.col("o_orderstatus")).alias("ord"), status.less(F.col("o_orderstatus"), F.lit("F")).alias("before_last"),
        "n", F.lit(status.first()).alias("first"), F.lit(status.last()).alias("last"), F.lit(",".join(status.between("O", None))).alias("from_open"),
    )
