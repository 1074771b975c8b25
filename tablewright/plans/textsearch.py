"""Full-text search over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import headlines
from tablewright.functions import textsearch as ts
from tablewright.functions.core import bind
from tablewright.operators import search
from tablewright.plans.registry import query

WORDS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
OCC = f"(SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents))"


def vec():
    """Vector of the document text."""
    return ts.to_vector(F.col("text"))


@query("fts_vector", "2.18.1", f"SELECT doc_id, md5(array_to_string({WORDS_SQL}, ' ')) AS terms, len({WORDS_SQL})::INTEGER AS n FROM documents")
def fts_vector(t):
    return t.spread("documents", "doc_id").select("doc_id", vec().alias("v")).select(
        "doc_id", F.md5(F.array_join(F.transform("v", lambda o: o["term"]), " ")).alias("terms"), F.size("v").alias("n")
    )


@query("fts_vector_english", "2.18.1 2.18.11")
def fts_vector_english(t):
    v = ts.to_vector(F.col("text"), "english")
    return t.spread("documents", "doc_id").select("doc_id", v.alias("v")).select("doc_id", F.size("v").alias("n"), F.array_join(ts.strip(F.col("v")), " ").alias("terms"))


@query(
    "fts_match", "2.18.2 2.18.3",
    f"""
    WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
    SELECT doc_id FROM w WHERE list_contains(w, 'the') AND (list_contains(w, 'with') OR len(list_filter(w, lambda x: starts_with(x, 'thr'))) > 0) AND NOT list_contains(w, 'by')
    """,
)
def fts_match(t):
    q = ts.to_query("the & (with | thr:*) & !by")
    return t.spread("documents", "doc_id").filter(ts.match_text(F.col("text"), q)).select("doc_id")


@query(
    "fts_phrase", "2.18.3 2.18.2",
    f"""
    WITH o AS {OCC}
    SELECT DISTINCT a.doc_id, 'adjacent' AS kind FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'
    UNION ALL
    SELECT DISTINCT a.doc_id, 'two apart' FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = 'is' AND b.term = 'the'
    """,
)
def fts_phrase(t):
    docs = t.spread("documents", "doc_id").select("doc_id", "text")
    text = F.col("text")
    near = docs.filter(ts.match_text(text, ts.phrase_query("of the"))).select("doc_id", F.lit("adjacent").alias("kind"))
    far = docs.filter(ts.match_text(text, ts.Term("is").then(ts.Term("the"), 2))).select("doc_id", F.lit("two apart").alias("kind"))
    return near.unionByName(far)


@query(
    "fts_weight_filter", "2.18.3 2.18.7",
    f"""
    WITH w AS (SELECT doc_id, lang, source, {WORDS_SQL} AS w FROM documents)
    SELECT doc_id, source = 'src1' AS in_title, list_contains(w, 'the') AS in_body, len(list_distinct(list_append(w, source)))::INTEGER AS uniq,
           len(list_distinct(list_filter(w, lambda x: x <> 'the' AND x <> 'of')))::INTEGER AS uniq_less, len(w)::INTEGER + 1 AS last_pos FROM w
    """,
)
def fts_weight_filter(t):
    title = ts.set_weight(ts.to_vector(F.col("source")), "A")
    docs = t.spread("documents", "doc_id").select("doc_id", vec().alias("body"), ts.append(title, vec()).alias("v"))
    v = F.col("v")
    return docs.select(
        "doc_id", ts.Term("src1", weights="A").on(v).alias("in_title"), ts.Term("the").on(ts.keep_weights(v, ["D"])).alias("in_body"), ts.length(v).alias("uniq"),
        ts.length(ts.delete(F.col("body"), ["the", "of"])).alias("uniq_less"), F.array_max(F.transform(v, lambda o: o["pos"])).alias("last_pos"),
    )


@query(
    "fts_rank", "2.18.4",
    f"""
    WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b FROM w),
    h AS (SELECT *, (SELECT coalesce(sum(0.1 / (j * j)), 0) FROM range(1, a + 1) r(j)) AS ha, (SELECT coalesce(sum(0.1 / (j * j)), 0) FROM range(1, b + 1) r(j)) AS hb FROM c)
    SELECT doc_id, round((ha / 1.64493406685 + hb / 1.64493406685) / 2, 6) AS any_rank,
           round((ha / 1.64493406685 + hb / 1.64493406685) / 2 / n, 9) AS per_word FROM h WHERE a > 0 OR b > 0
    """,
)
def fts_rank(t):
    q = ts.Term("the") | ts.Term("with")
    scores = lambda v: F.struct(ts.rank(v, q).alias("r"), F.size(v).alias("n"))
    docs = t.spread("documents", "doc_id").select("doc_id", bind(vec(), scores).alias("s")).filter("s.r > 0")
    return docs.select("doc_id", F.round("s.r", 6).alias("any_rank"), F.round(F.col("s.r") / F.col("s.n"), 9).alias("per_word"))


@query(
    "fts_rank_near", "2.18.4",
    f"""
    WITH o AS {OCC}
    SELECT a.doc_id, round(1 - exp(sum(ln(1 - sqrt(0.1 * 0.1 * CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1.0 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END)))), 6) AS rank
    FROM o a JOIN o b ON a.doc_id = b.doc_id WHERE a.term = 'with' AND b.term = 'was' GROUP BY a.doc_id
    """,
)
def fts_rank_near(t):
    q = ts.Term("with") & ts.Term("was")
    scores = lambda v: F.struct(q.on(v).alias("hit"), F.round(ts.rank(v, q), 6).alias("rank"))
    docs = t.spread("documents", "doc_id").select("doc_id", bind(vec(), scores).alias("s"))
    return docs.filter("s.hit").select("doc_id", "s.rank")


@query(
    "fts_rank_cover", "2.18.4",
    f"""
    WITH o AS (SELECT * FROM {OCC} WHERE term IN ('with', 'was')),
    m AS (SELECT *, row_number() OVER w AS i, max(CASE WHEN term = 'with' THEN pos END) OVER w AS pa, max(CASE WHEN term = 'was' THEN pos END) OVER w AS pb FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    e AS (SELECT doc_id, least(pa, pb) AS p, min(pos) AS q, min(i) AS qi FROM m WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY ALL)
    SELECT e.doc_id, round(sum(0.1 / (1 + (q - p) - (qi - m.i))), 6) AS rank, count(*) AS covers FROM e JOIN m ON m.doc_id = e.doc_id AND m.pos = e.p GROUP BY 1
    """,
)
def fts_rank_cover(t):
    q = ts.Term("with") & ts.Term("was")
    return search.cover_rank(t.spread("documents", "doc_id"), "doc_id", vec(), q).select("doc_id", F.round("rank", 6).alias("rank"), "covers")


@query(
    "fts_rank_cover_nested", "2.18.4",
    f"""
    WITH o AS (SELECT doc_id, pos, CASE term WHEN 'with' THEN 'a' WHEN 'of' THEN 'n' ELSE 'b' END AS part FROM {OCC} WHERE term IN ('with', 'was', 'by', 'of')),
    m AS (SELECT *, row_number() OVER w AS i, max(CASE WHEN part = 'a' THEN pos END) OVER w AS pa, max(CASE WHEN part = 'b' THEN pos END) OVER w AS pb FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    e AS (SELECT doc_id, least(pa, pb) AS p, min(pos) AS q, min(i) AS qi FROM m WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY ALL),
    c AS (SELECT e.doc_id, p, q, qi - m.i + 1 AS k FROM e JOIN m ON m.doc_id = e.doc_id AND m.pos = e.p
          WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = e.doc_id AND o.part = 'n' AND o.pos BETWEEN e.p AND e.q)),
    d AS (SELECT *, (p + q) / 2 - lag((p + q) / 2) OVER (PARTITION BY doc_id ORDER BY q) AS gap FROM c)
    SELECT doc_id, round(sum(0.1 / (1 + (q - p) - (k - 1))) / CASE WHEN sum(1 / gap) > 0 THEN count(*) / sum(1 / gap) ELSE 1 END, 6) AS rank, count(*) AS covers FROM d GROUP BY 1
    """,
)
def fts_rank_cover_nested(t):
    q = ts.to_query("with & (was | by) & !of")
    return search.cover_rank(t.spread("documents", "doc_id"), "doc_id", vec(), q, norm=4).select("doc_id", F.round("rank", 6).alias("rank"), "covers")


@query(
    "fts_query_text", "2.18.2 2.18.3",
    f"""
    WITH o AS {OCC}, w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    p AS (SELECT DISTINCT a.doc_id FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term IN ('the', 'that')),
    q AS (SELECT DISTINCT a.doc_id FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 WHERE a.term = 'is' AND b.term = 'the'),
    n AS (SELECT DISTINCT a.doc_id FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'with' AND b.term = 'the')
    SELECT doc_id, doc_id IN (FROM p) AS near, doc_id IN (FROM q) AS far, list_contains(w, 'with') AND doc_id NOT IN (FROM n) AS excluded FROM w
    WHERE doc_id IN (FROM p) OR doc_id IN (FROM q) OR list_contains(w, 'with') AND doc_id NOT IN (FROM n)
    """,
)
def fts_query_text(t):
    near, far, excluded = (ts.to_query(q) for q in ("of <-> (the | 'that')", "is <2> the", "with <-> !the"))
    hits = lambda v: F.struct(near.on(v).alias("near"), far.on(v).alias("far"), excluded.on(v).alias("excluded"))
    found = t.spread("documents", "doc_id").select("doc_id", bind(vec(), hits).alias("h")).select("doc_id", "h.*")
    return found.filter("near OR far OR excluded")


@query(
    "fts_headline", "2.18.5",
    r"""
    SELECT doc_id, regexp_replace(text, '(^|[^\p{L}\p{N}])(the|of)($|[^\p{L}\p{N}])', '\1<b>\2</b>\3', 'gi') IS NOT NULL AS marked,
           (length(text) + 7 * len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x = 'the' OR x = 'of')))::INTEGER AS n FROM documents
    """,
)
def fts_headline(t):
    h = ts.headline(F.col("text"), ["the", "of"])
    return t.spread("documents", "doc_id").select("doc_id", h.isNotNull().alias("marked"), F.length(h).alias("n"))


@query(
    "fts_headline_stretch", "2.18.5",
    r"""
    WITH d AS (
      SELECT doc_id, w, len(w) AS n, list_transform(w, lambda x: NOT regexp_full_match(x, '\p{N}+')) AS ends,
             list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the') AS hits
      FROM (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM documents)),
    m AS (SELECT doc_id, unnest(hits) AS a FROM d),
    r AS (SELECT doc_id, a, CASE WHEN a + 9 < n AND NOT ends[a + 9] AND ends[a + 10] THEN a + 10 ELSE least(a + 9, n) END AS b FROM m JOIN d USING (doc_id)),
    l AS (SELECT doc_id, a AS spot, b, CASE WHEN b - a >= 9 THEN a WHEN n > 10 AND NOT ends[n - 9] THEN n - 10 ELSE greatest(n - 9, 1) END AS a FROM r JOIN d USING (doc_id)),
    c AS (SELECT doc_id, spot, a, b, ends[b] AS well, len(list_filter(hits, lambda i: i BETWEEN a AND b)) AS k FROM l JOIN d USING (doc_id)),
    best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY well DESC, k DESC, spot) = 1)
    SELECT d.doc_id, md5(array_to_string(w[coalesce(a, 1):coalesce(b, least(10, n))], ' ')) AS words,
           (coalesce(b, least(10, n)) - coalesce(a, 1) + 1)::INTEGER AS n_words, CASE WHEN w IS NOT NULL THEN coalesce(k, 0) END::INTEGER AS n_hits
    FROM d LEFT JOIN best USING (doc_id)
    """,
)
def fts_headline_stretch(t):
    options = headlines.Options(max_words=11, min_words=10, short_word=0, start_sel="\x01", stop_sel="\x02")
    shown = headlines.headline(F.col("text"), ts.to_query("the"), options)
    out = t.spread("documents", "doc_id").select("doc_id", shown.alias("h"))
    words = F.regexp_extract_all(F.lower("h"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    marks = F.length("h") - F.length(F.replace("h", F.lit("\x01"), F.lit("")))
    return out.select("doc_id", F.md5(F.array_join(words, " ")).alias("words"), F.size(words).alias("n_words"), marks.alias("n_hits"))


@query("fts_headline_fragments", "2.18.5")
def fts_headline_fragments(t):
    q = ts.to_query("water | (city & people) | first <-> time", "english")
    shown = headlines.headline(F.col("text"), q, "MaxFragments=3, MaxWords=20, MinWords=5, FragmentDelimiter=\" ... \"", "english")
    return t.spread("documents", "doc_id").select("doc_id", shown.alias("fragments"))


@query("fts_term_stats", "2.18.6", f"SELECT term, count(DISTINCT doc_id) AS ndoc, count(*) AS nentry FROM {OCC} GROUP BY 1")
def fts_term_stats(t):
    return search.term_statistics(t.spread("documents", "doc_id"), "doc_id", vec())


@query(
    "fts_query_algebra", "2.18.8",
    f"""
    WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents)
    SELECT doc_id, 5::INTEGER AS nodes, true AS holds, '''the'' & ( ''was'' | ''were'' )' AS rewritten FROM w WHERE list_contains(w, 'the') AND (list_contains(w, 'was') OR list_contains(w, 'were'))
    """,
)
def fts_query_algebra(t):
    # the substitute comes from the data: the rule table has one row per listed word
    q = ts.Term("the") & ts.Term("verb")
    rules = {ts.Term("verb"): ts.Term("was") | ts.Term("were")}
    new = q.rewrite(rules)
    return t.spread("documents", "doc_id").filter(ts.match_text(F.col("text"), new)).select(
        "doc_id", F.lit(new.nodes()).alias("nodes"), F.lit(new.holds(ts.Term("was"))).alias("holds"), F.lit(repr(new)).alias("rewritten")
    )


# the check engine has no look-ahead, so the token test compares the stream put together again
@query("fts_parse", "2.18.9", "SELECT doc_id, md5(text) AS digest, true AS known FROM documents")
def fts_parse(t):
    p = ts.parse(F.col("text"))
    return t.spread("documents", "doc_id").select("doc_id", p.alias("p")).select(
        "doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["token"]), "")).alias("digest"),
        F.forall("p", lambda x: ts.type_name(x["tokid"]).isNotNull()).alias("known"),
    )


@query("fts_token_types", "2.18.9")
def fts_token_types(t):
    return (
        t.spread("documents", "doc_id").select(F.explode(ts.parse(F.col("text"))).alias("p"))
        .groupBy(F.col("p.tokid").alias("tokid")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("p.token")).alias("longest"))
        .withColumn("alias", ts.type_name(F.col("tokid")))
    )


@query(
    "fts_dictionaries", "2.18.10",
    f"""
    WITH o AS {OCC}, d AS (SELECT doc_id, CASE WHEN term IN ('the', 'that') THEN 'det' WHEN term IN ('is', 'was', 'be') THEN 'verb' WHEN regexp_full_match(term, '[0-9]+') THEN substr(term, 1, 3) ELSE term END AS term FROM o)
    SELECT term, count(*) AS n FROM d GROUP BY 1
    """,
)
def fts_dictionaries(t):
    pairs = [("the", "det"), ("that", "det"), ("is", "verb"), ("was", "verb"), ("be", "verb")]
    synonyms = t.spark.createDataFrame(pairs, "word string, to string")
    # counts per word first: the dictionary join sees each distinct word once
    tokens = t.spread("documents", "doc_id").select(F.explode(ts.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    tokens = tokens.withColumn("term", search.integer_dictionary(F.col("term"), 3))
    return search.apply_dictionary(tokens, "term", synonyms, "word", "to").groupBy("term").agg(F.sum("n").alias("n"))


@query(
    "fts_thesaurus", "2.18.10",
    f"""
    WITH o AS (SELECT *, lead(term) OVER w AS next, lag(term) OVER w AS before FROM {OCC} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    r AS (SELECT doc_id, pos, CASE WHEN term IN ('by', 'of') AND next = 'the' THEN term || 'the' WHEN term = 'the' AND before IN ('by', 'of') THEN NULL WHEN term = 'of' THEN 'by' ELSE term END AS term FROM o)
    SELECT d.doc_id, md5(coalesce(string_agg(term, ' ' ORDER BY pos), '')) AS digest FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND term IS NOT NULL GROUP BY 1
    """,
)
def fts_thesaurus(t):
    # 'of' becomes 'by', and that 'by' does not begin 'by the'
    words = search.thesaurus(ts.words(F.col("text")), {"of": "by", "by the": "bythe", "of the": "ofthe"})
    return t.spread("documents", "doc_id").select("doc_id", F.md5(F.array_join(words, " ")).alias("digest"))


@query(
    "fts_extended_synonyms", "2.18.10",
    f"""
    WITH r(word, others) AS (VALUES ('the', ['that', 'this']), ('is', ['was', 'be'])), o AS (SELECT term, count(*) AS n FROM {OCC} GROUP BY 1),
    m AS (SELECT word AS w, list_prepend(word, others) AS outs FROM r UNION ALL SELECT unnest(others), list_prepend(word, others) FROM r)
    SELECT term, sum(n)::BIGINT AS n FROM (SELECT unnest(coalesce(outs, [term])) AS term, n FROM o LEFT JOIN m ON m.w = o.term) GROUP BY 1
    """,
)
def fts_extended_synonyms(t):
    rules = t.spark.createDataFrame([("the", ["that", "this"]), ("is", ["was", "be"])], "word string, others array<string>")
    tokens = t.spread("documents", "doc_id").select(F.explode(ts.words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return search.extended_synonyms(tokens, "term", rules, "word", "others", match_synonyms=True).groupBy("term").agg(F.sum("n").alias("n"))


@query("fts_stems", "2.18.11")
def fts_stems(t):
    words = t.spread("documents", "doc_id").select(F.explode(ts.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", ts.stem_english(F.col("word")).alias("stem"))


#: Configuration of each language tag of the documents.
CONFIGS = {"en": "english", "de": "german", "es": "spanish", "fr": "french"}


@query("fts_stems_by_language", "2.18.11")
def fts_stems_by_language(t):
    # each distinct word of a language is stemmed once
    config = F.coalesce(*[F.when(F.col("lang") == tag, F.lit(name)) for tag, name in CONFIGS.items()], F.lit("simple"))
    words = t.spread("documents", "doc_id").select(config.alias("config"), F.explode(ts.words(F.col("text"))).alias("word")).distinct()
    return words.select("config", "word", ts.stem_by(F.col("word"), F.col("config")).alias("stem"))


@query(
    "fts_lexize", "2.18.9",
    f"""
    SELECT word, CASE WHEN word IN ({", ".join(f"'{w}'" for w in ts.STOP_ENGLISH)}) THEN 0 ELSE 1 END::INTEGER AS english_lexemes,
           CASE WHEN word IN ('der', 'die', 'das') THEN '' ELSE word END AS kept
    FROM (SELECT DISTINCT unnest({WORDS_SQL}) AS word FROM documents)
    """,
)
def fts_lexize(t):
    words = t.spread("documents", "doc_id").select(F.explode(ts.words(F.col("text"))).alias("word")).distinct()
    return words.select(
        "word", F.size(ts.lexize(F.col("word"), "english")).alias("english_lexemes"),
        F.array_join(ts.lexize(F.col("word"), "simple", ["der", "die", "das"]), "").alias("kept"),
    )


@query("fts_debug", "2.18.9")
def fts_debug(t):
    # tokens are counted first, so each distinct one is typed and stemmed once
    found = t.spread("documents", "doc_id").select(F.explode(ts.tokens(F.col("text"))).alias("t"))
    typed = found.groupBy("t").agg(F.count(F.lit(1)).alias("k")).select(ts.token_type(F.col("t")).alias("tokid"), F.lower("t").alias("token"), "k")
    counted = typed.groupBy("tokid", "token").agg(F.sum("k").alias("k"))
    stemmed = ts.stem(F.col("token"), "english")
    told = counted.select(ts.described(F.col("tokid"), F.col("token"), stemmed, "english", ts.STOPS["english"]).alias("d"), "k")
    return told.groupBy("d.alias", "d.dictionary", F.array_join("d.lexemes", ",").alias("lexemes")).agg(F.sum("k").alias("n"))


@query(
    "fts_affix_dictionary", "2.18.11",
    rf"""
    WITH v AS (SELECT DISTINCT unnest({WORDS_SQL}) AS w FROM documents),
    c AS (SELECT w AS word, w AS base FROM v UNION SELECT w, w[1:length(w)-3] FROM v WHERE w LIKE '%ing' UNION SELECT w, w[1:length(w)-3] || 'y' FROM v WHERE w LIKE '%ies' UNION SELECT w, w[1:length(w)-1] FROM v WHERE w LIKE '%s')
    SELECT word, base FROM c WHERE base IN (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark)
    """,
)
def fts_affix_dictionary(t):
    tokens = t.spread("documents", "doc_id").select(F.explode(ts.words(F.col("text"))).alias("word"))
    known = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w"))
    return search.affix_stems(tokens, "word", [("ing", ""), ("ies", "y"), ("s", "")], known, "w")
