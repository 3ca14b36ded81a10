"""DuckDB SQL fragments used by the oracle queries.

They restate each operator's rule in plain SQL over the same parquet tables,
independently of the Spark code paths (RE2 instead of Java regex, list
lambdas instead of Spark higher-order functions).
"""

from __future__ import annotations

from .. import defaults as D
from ..functions.stem import IRREGULAR, STEPS
from . import params as P


#: Digits to which ranks are compared when the best sentences are chosen.
RANK_DIGITS = 12


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def normalize(x: str, fillers=None) -> str:
    fillers = "|".join(fillers or D.FILLERS)
    return ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
            f"trim(lower(coalesce({x}, ''))), '[^\\x00-\\x7F]+', ' ', 'g'), "
            "'[^\\w\\s.,!?'']', ' ', 'g'), "
            f"'\\b({fillers})\\b', '', 'gi'), "
            "'\\s+', ' ', 'g'))")


def role(x: str, keywords=None) -> str:
    kws = keywords or P.ROLE_KEYWORDS
    cond = " OR ".join(f"contains(lower(coalesce({x}, '')), {lit(k)})" for k in kws)
    return f"CASE WHEN {cond} THEN 'counselor' ELSE 'client' END"


def split_sentences(x: str) -> str:
    return ("list_filter(list_transform(string_split(regexp_replace(coalesce(" + x
            + r", ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')")


def lexicon_case(x: str, lexicon=None) -> str:
    lex = lexicon or P.LEXICON
    parts = []
    for tier in sorted(lex, reverse=True):
        cond = " OR ".join(f"contains(lower({x}), {lit(p)})" for p in lex[tier])
        parts.append(f"WHEN {cond} THEN {tier}")
    return "CASE " + " ".join(parts) + " ELSE 1 END"


def tier_label(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {k} THEN {lit(v)}" for k, v in sorted(D.TIER_LABELS.items())) + " END"


def section_case(x: str, rules=None) -> str:
    parts = []
    for name, patterns in (rules or P.SECTION_RULES):
        if not patterns:
            continue
        cond = " OR ".join(f"regexp_matches({x}, {lit(p)}, 'i')" for p in patterns)
        parts.append(f"WHEN {cond} THEN {lit(name)}")
    return "CASE " + " ".join(parts) + " END"


def utt_cte() -> str:
    """Preprocessed utterances of ``conversations`` (clean text and role)."""
    return ("utt AS (SELECT conv_id AS session_id, turn, role AS speaker, text AS utterance, "
            f"{normalize('text')} AS clean_text, {role('role')} AS spk_role "
            "FROM conversations WHERE conv_id IS NOT NULL)")


def gapped_utt_cte() -> str:
    """Utterances without ``system`` turns; ``turn`` is the row number, ``orig`` the given one."""
    return ("utt AS (SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, "
            f"turn AS orig, {normalize('text')} AS clean_text FROM conversations "
            "WHERE conv_id IS NOT NULL AND role <> 'system')")


def role_text_cte() -> str:
    return ("rt0 AS (SELECT session_id, "
            "coalesce(string_agg(clean_text, ' ' ORDER BY turn) FILTER (WHERE spk_role = 'client'), '') AS client_text, "
            "coalesce(string_agg(clean_text, ' ' ORDER BY turn) FILTER (WHERE spk_role = 'counselor'), '') AS counselor_text "
            "FROM utt GROUP BY session_id), "
            "rt AS (SELECT session_id, client_text, counselor_text, client_text || ' ' || counselor_text AS combined_text FROM rt0)")


def session_text_cte(name: str = "st", col: str = "session_text") -> str:
    return f"{name} AS (SELECT session_id, string_agg(clean_text, ' ' ORDER BY turn) AS {col} FROM utt GROUP BY session_id)"


def stop_words_sql() -> str:
    return sql_list(D.spark_english_stop_words())


def tfidf_ctes(max_features: int = D.TFIDF_MAX_FEATURES) -> str:
    """``tc`` term counts, ``voc`` capped vocabulary, ``wt`` L2-normalised weights."""
    return (
        "tok AS (SELECT session_id, turn, unnest(regexp_extract_all(clean_text, '\\b\\w\\w+\\b')) AS term FROM utt), "
        f"tc AS (SELECT session_id, turn, term, count(*) AS tf FROM tok WHERE NOT list_contains({stop_words_sql()}, term) "
        "GROUP BY session_id, turn, term), "
        "voc0 AS (SELECT session_id, term, sum(tf) AS total, count(*) AS df FROM tc GROUP BY session_id, term), "
        "voc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY total DESC, term) AS rk "
        f"FROM voc0) WHERE rk <= {max_features}), "
        "nd AS (SELECT session_id, count(*) AS n FROM utt GROUP BY session_id), "
        "raw AS (SELECT tc.session_id, tc.turn, tc.term, tc.tf * (ln((nd.n + 1.0) / (voc.df + 1.0)) + 1.0) AS raw "
        "FROM tc JOIN voc ON tc.session_id = voc.session_id AND tc.term = voc.term "
        "JOIN nd ON tc.session_id = nd.session_id), "
        "wt AS (SELECT session_id, turn, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY session_id, turn)) AS w "
        "FROM raw)")


def similarity_ctes() -> str:
    return (tfidf_ctes() + ", "
            "dots AS (SELECT a.session_id, a.turn, sum(a.w * b.w) AS dot FROM wt a JOIN wt b "
            "ON a.session_id = b.session_id AND a.term = b.term AND b.turn = a.turn - 1 GROUP BY a.session_id, a.turn), "
            "sim AS (SELECT u.session_id, u.turn, coalesce(d.dot, 0.0) AS similarity FROM utt u "
            "JOIN utt p ON p.session_id = u.session_id AND p.turn = u.turn - 1 "
            "LEFT JOIN dots d ON d.session_id = u.session_id AND d.turn = u.turn)")


def segment_ctes(threshold: float) -> str:
    return (similarity_ctes() + ", "
            "seg AS (SELECT u.session_id, u.turn, u.clean_text, CAST(sum(CASE WHEN s.similarity < "
            f"{threshold!r} THEN 1 ELSE 0 END) OVER (PARTITION BY u.session_id ORDER BY u.turn "
            "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id "
            "FROM utt u LEFT JOIN sim s ON s.session_id = u.session_id AND s.turn = u.turn)")


def top_terms_ctes(threshold: float, k: int = D.TOPIC_WORDS, max_features: int = D.COUNT_MAX_FEATURES) -> str:
    return (segment_ctes(threshold) + ", "
            "cvoc AS (SELECT * FROM (SELECT session_id, term, row_number() OVER (PARTITION BY session_id "
            f"ORDER BY total DESC, term) AS rk FROM voc0) WHERE rk <= {max_features}), "
            "sc AS (SELECT tc.session_id, seg.segment_id, tc.term, sum(tc.tf) AS n FROM tc "
            "JOIN cvoc ON tc.session_id = cvoc.session_id AND tc.term = cvoc.term "
            "JOIN seg ON tc.session_id = seg.session_id AND tc.turn = seg.turn "
            "GROUP BY tc.session_id, seg.segment_id, tc.term), "
            "tt AS (SELECT * FROM (SELECT session_id, segment_id, CAST(row_number() OVER (PARTITION BY session_id, "
            f"segment_id ORDER BY n DESC, term) AS INTEGER) AS rank, term, n FROM sc) WHERE rank <= {k})")


def rouge_pairs_cte() -> str:
    """All counselor turns and all client turns of each session as candidate / reference."""
    return (f"{utt_cte()}, {role_text_cte()}, "
            "pairs AS (SELECT session_id, counselor_text AS candidate, client_text AS reference FROM rt "
            "WHERE counselor_text <> '' AND client_text <> '')")


def overlap_tokens(x: str) -> str:
    return (f"list_filter(string_split(trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), "
            "lambda t: t <> '')")


def terms_sql(x: str) -> str:
    """The terms of a linear classifier."""
    return f"list_filter({overlap_tokens(x)}, lambda t: length(t) > 1 AND NOT list_contains({stop_words_sql()}, t))"


def bayes_ctes(train: str, texts: str, labels: list[str]) -> str:
    """CTEs ending in ``pb (key, label, place, p)``: naive Bayes of ``train (label, text)`` on ``texts (key, text)``."""
    rows = ", ".join(f"({lit(x)}, {i})" for i, x in enumerate(labels))
    return (f"lab(label, place) AS (VALUES {rows}), trn AS (SELECT t.label, {terms_sql('t.text')} AS terms FROM {train} t JOIN lab USING (label)), "
            "cnt AS MATERIALIZED (SELECT label, term, count(*) AS n FROM (SELECT label, unnest(terms) AS term FROM trn) GROUP BY ALL), "
            "cls AS MATERIALIZED (SELECT lab.label, lab.place, ln((coalesce(d.docs, 0) + 1.0) / ((SELECT count(*) FROM trn) "
            f"+ {len(labels)}.0)) AS b, ln(1.0 / (coalesce(k.toks, 0) + greatest((SELECT count(DISTINCT term) FROM cnt), 1))) AS g FROM lab "
            "LEFT JOIN (SELECT label, count(*) AS docs FROM trn GROUP BY label) d ON d.label = lab.label "
            "LEFT JOIN (SELECT label, sum(n) AS toks FROM cnt GROUP BY label) k ON k.label = lab.label), "
            f"tf AS (SELECT key, term, count(*) AS f FROM (SELECT key, unnest({terms_sql('text')}) AS term FROM {texts}) GROUP BY ALL), "
            "kn AS (SELECT key, sum(f) AS n FROM tf SEMI JOIN cnt USING (term) GROUP BY key), "
            "ws AS (SELECT tf.key, cnt.label, sum(tf.f * ln(cnt.n + 1.0)) AS s FROM tf JOIN cnt USING (term) GROUP BY ALL), "
            "sc AS (SELECT x.key, cls.label, cls.place, cls.b + coalesce(kn.n, 0) * cls.g + coalesce(ws.s, 0) AS s "
            f"FROM {texts} x CROSS JOIN cls LEFT JOIN kn ON kn.key = x.key LEFT JOIN ws ON ws.key = x.key AND ws.label = cls.label), "
            "ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY key)) AS e FROM sc), "
            "pb AS (SELECT key, label, place, e / sum(e) OVER (PARTITION BY key) AS p FROM ex)")


def rouge_n_select(n: int, pairs: str = "pairs", keys: str = "session_id") -> str:
    """A query (no WITH) computing precision/recall/f1 per pair of ``pairs``."""
    kl = [k.strip() for k in keys.split(",")]
    kj = " AND ".join(f"a.{k} = b.{k}" for k in kl)
    kb = ", ".join(f"b.{k}" for k in kl)
    grams = (lambda side: f"(SELECT {keys}, g, count(*) AS n FROM (SELECT {keys}, unnest(list_transform("
             f"generate_series(1, len({side}) - {n - 1}), lambda i: array_to_string({side}[i:i + {n - 1}], ' '))) AS g "
             f"FROM tk) GROUP BY {keys}, g)")
    return (f"(WITH tk AS (SELECT {keys}, {overlap_tokens('candidate')} AS c, {overlap_tokens('reference')} AS r "
            f"FROM {pairs}), cg AS {grams('c')}, rg AS {grams('r')}, "
            f"ov AS (SELECT {kb}, sum(least(a.n, b.n)) AS ov FROM cg a JOIN rg b ON {kj} AND a.g = b.g "
            f"GROUP BY {kb}), "
            f"s AS (SELECT {', '.join('t.' + k for k in kl)}, CAST(coalesce(ov.ov, 0) AS DOUBLE) AS ov, "
            f"greatest(len(t.c) - {n - 1}, 0) AS tc, greatest(len(t.r) - {n - 1}, 0) AS tr "
            f"FROM tk t LEFT JOIN ov ON {' AND '.join(f't.{k} = ov.{k}' for k in kl)}), "
            "pr AS (SELECT *, ov / greatest(tc, 1) AS p, ov / greatest(tr, 1) AS rc FROM s) "
            f"SELECT {keys}, p AS precision, rc AS recall, "
            "CASE WHEN p + rc > 0 THEN 2.0 * p * rc / (p + rc) ELSE 0.0 END AS f1 FROM pr)")


def annotated_cte() -> str:
    return ("ann AS (SELECT conv_id AS session_id, turn AS row_pos, "
            "CASE WHEN role = 'system' THEN 'Summary' ELSE text END AS Utterance, "
            "CASE WHEN role = 'system' THEN text END AS Sub_topic, "
            "CASE WHEN role = 'assistant' THEN 'T' ELSE 'P' END AS Type FROM conversations), "
            f"annm AS (SELECT *, coalesce(lower(Utterance) IN ({', '.join(lit(k) for k in D.META_KEYWORDS)}), false) "
            "AS is_meta FROM ann), "
            "refs AS (SELECT session_id, arg_min(Sub_topic, row_pos) AS reference_summary FROM ann "
            "WHERE lower(Utterance) = 'summary' GROUP BY session_id), "
            "refs_ok AS (SELECT * FROM refs WHERE reference_summary IS NOT NULL AND "
            "regexp_replace(reference_summary, '^\\s+|\\s+$', '', 'g') <> ''), "
            "autt AS (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY row_pos) - 1 AS BIGINT) "
            "AS turn, CASE WHEN regexp_replace(Type, '^\\s+|\\s+$', '', 'g') = 'T' THEN 'counselor' ELSE 'client' END "
            "AS speaker, Utterance AS utterance FROM annm WHERE NOT is_meta), "
            "sess AS (SELECT a.session_id, string_agg(coalesce(a.utterance, ''), ' ' ORDER BY a.turn) AS transcript, "
            "r.reference_summary FROM autt a JOIN refs_ok r ON a.session_id = r.session_id "
            "GROUP BY a.session_id, r.reference_summary)")


def qa_cte(min_chars: int = D.MIN_ANSWER_CHARS) -> str:
    return ("qa AS (SELECT CAST(q.conv_id AS VARCHAR) || ':' || CAST(q.turn AS VARCHAR) AS pair_key, "
            "q.text AS transcript, a.text AS reference_summary FROM conversations q JOIN conversations a "
            "ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' "
            f"AND length(a.text) > {min_chars})")


def pairs_cte() -> str:
    return (annotated_cte() + ", " + qa_cte() + ", "
            "tp AS (SELECT 0 AS source_rank, CAST(session_id AS VARCHAR) AS pair_key, transcript, reference_summary "
            "FROM sess UNION ALL SELECT 1 AS source_rank, pair_key, transcript, reference_summary FROM qa), "
            "tpn AS (SELECT * FROM tp WHERE transcript IS NOT NULL AND reference_summary IS NOT NULL)")


def encode_label(x: str, labels) -> str:
    return f"coalesce(list_position({sql_list(labels)}, lower({x})) - 1, 0)"


def graph_ctes() -> str:
    """CTEs of the sentence graph of every session: ``x`` sentences, ``wl`` lengths, ``e`` weighted edges."""
    return (f"{session_text_cte('st', 'summary')}, "
            f"s AS (SELECT session_id, {split_sentences('summary')} AS sents FROM st), "
            "x AS (SELECT session_id, CAST(unnest(generate_series(0, len(sents) - 1)) AS INTEGER) AS sent_pos, "
            "unnest(sents) AS sentence FROM s), "
            "w AS (SELECT session_id, sent_pos, list_filter(regexp_extract_all(lower(sentence), '[\\w''-]+'), "
            "lambda t: regexp_full_match(t, '[a-z][a-z''-]*')) AS words FROM x), "
            "wl AS (SELECT session_id, sent_pos, CAST(len(words) AS BIGINT) AS l FROM w), "
            "wc AS (SELECT session_id, sent_pos, word, count(*) AS c FROM "
            "(SELECT session_id, sent_pos, unnest(words) AS word FROM w) GROUP BY session_id, sent_pos, word), "
            "pr AS (SELECT a.session_id, a.sent_pos AS i, b.sent_pos AS j, sum(a.c * b.c) AS shared FROM wc a "
            "JOIN wc b ON a.session_id = b.session_id AND a.word = b.word GROUP BY a.session_id, a.sent_pos, b.sent_pos), "
            "e AS MATERIALIZED (SELECT pr.session_id, pr.i, pr.j, CASE WHEN li.l = 1 AND lj.l = 1 THEN shared "
            "ELSE shared / (ln(li.l) + ln(lj.l)) END AS w FROM pr "
            "JOIN wl li ON li.session_id = pr.session_id AND li.sent_pos = pr.i "
            "JOIN wl lj ON lj.session_id = pr.session_id AND lj.sent_pos = pr.j)")


def textrank_ctes(n: int = D.TEXTRANK_SENTENCES) -> str:
    """CTEs ending in ``tr(session_id, generated_summary)``: the power method by recursion. Needs RECURSIVE."""
    d = D.TEXTRANK_DAMPING
    return (f"{graph_ctes()}, "
            "deg AS (SELECT session_id, i, sum(w) AS d FROM e GROUP BY session_id, i), "
            f"col AS (SELECT a.session_id, a.sent_pos, list(coalesce({d} * e.w / (deg.d + 1e-7), 0.0) ORDER BY b.sent_pos) AS c "
            "FROM wl a JOIN wl b ON a.session_id = b.session_id "
            "LEFT JOIN e ON e.session_id = a.session_id AND e.i = b.sent_pos AND e.j = a.sent_pos "
            "LEFT JOIN deg ON deg.session_id = b.session_id AND deg.i = b.sent_pos GROUP BY a.session_id, a.sent_pos), "
            "mat AS MATERIALIZED (SELECT session_id, list(CAST(c AS DOUBLE[]) ORDER BY sent_pos) AS m, count(*) AS n FROM col GROUP BY session_id), "
            "power AS (SELECT session_id, 0 AS it, list_transform(m, lambda c: CAST(1.0 AS DOUBLE) / n) AS p, CAST(1.0 AS DOUBLE) AS lam FROM mat "
            "UNION ALL SELECT session_id, it + 1, q, sqrt(list_sum(list_transform(range(1, n + 1), lambda i: (q[i] - p[i]) * (q[i] - p[i])))) "
            f"FROM (SELECT r.session_id, r.it, r.p, mat.n, list_transform(mat.m, lambda c: CAST({1 - d!r} AS DOUBLE) / mat.n * list_sum(r.p) "
            f"+ list_dot_product(c, r.p)) AS q FROM power r JOIN mat ON r.session_id = mat.session_id WHERE r.lam > {D.TEXTRANK_EPSILON})), "
            "fin AS (SELECT session_id, p FROM power QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY it DESC) = 1), "
            "rk AS (SELECT session_id, unnest(p) AS rank, unnest(range(len(p))) AS sent_pos FROM fin), "
            f"best AS (SELECT session_id, sent_pos FROM rk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY round(rank, {RANK_DIGITS}) DESC, sent_pos) <= {n}), "
            "chosen AS (SELECT x.session_id, string_agg(x.sentence, ' ' ORDER BY x.sent_pos) AS summary FROM x "
            "JOIN best ON best.session_id = x.session_id AND best.sent_pos = x.sent_pos GROUP BY x.session_id), "
            "tr AS (SELECT st.session_id, coalesce(chosen.summary, '') AS generated_summary FROM st LEFT JOIN chosen ON chosen.session_id = st.session_id)")


def rouge_l_select(pairs: str = "pairs", keys: str = "session_id") -> str:
    """A query (no WITH): precision/recall/f1 of the longest common subsequence. Its length is that of
    the longest increasing run of matching places, taken by patience sorting."""
    kl = [k.strip() for k in keys.split(",")]
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in kl)
    kc = ", ".join(f"c.{k}" for k in kl)
    places = lambda side: (f"(SELECT {keys}, unnest({side}) AS w, unnest(range(len({side}))) AS pos FROM tk)")
    less = "len(list_filter(a, lambda t: t < x[1]))"
    return (f"(WITH tk AS (SELECT {keys}, {overlap_tokens('candidate')} AS c, {overlap_tokens('reference')} AS r FROM {pairs}), "
            f"js AS (SELECT {kc}, list([r.pos] ORDER BY c.pos, r.pos DESC) AS m FROM {places('c')} c "
            f"JOIN {places('r')} r ON {on('c', 'r')} AND c.w = r.w GROUP BY {kc}), "
            f"n AS (SELECT {keys}, len(list_reduce(m, lambda a, x: a[1:{less}] || x || a[{less} + 2:])) AS lcs FROM js), "
            f"s AS (SELECT {', '.join('t.' + k for k in kl)}, CAST(coalesce(n.lcs, 0) AS DOUBLE) AS lcs, len(t.c) AS tc, len(t.r) AS tr "
            f"FROM tk t LEFT JOIN n ON {on('t', 'n')}), "
            "pr AS (SELECT *, lcs / greatest(tc, 1) AS p, lcs / greatest(tr, 1) AS rc FROM s) "
            f"SELECT {keys}, p AS precision, rc AS recall, "
            "CASE WHEN p + rc > 0 THEN 2.0 * p * rc / (p + rc) ELSE 0.0 END AS f1 FROM pr)")


def stem_ctes(tokens: str) -> str:
    """CTEs ending in ``stems (token, stem)`` for the query ``tokens`` of one column ``token``."""
    def step(rules):
        cases = ""
        for suffix, replacement, condition, kept, other in rules:
            rest = f"left(w, length(w) - {len(suffix)})"
            to = f"{rest} || '{replacement}'"
            if condition is not None:
                failed = "w" if other is None else f"{rest} || '{other}'"
                to = f"CASE WHEN regexp_matches({rest} || '{kept}', '{condition}') THEN {to} ELSE {failed} END"
            cases += f" WHEN ends_with(w, '{suffix}') THEN {to}"
        return f"CASE{cases} ELSE w END"

    out = f"w0 AS MATERIALIZED (SELECT DISTINCT token, regexp_replace(token, '^y', 'Y') AS w FROM ({tokens}))"
    for i, rules in enumerate(STEPS):
        out += f", w{i + 1} AS MATERIALIZED (SELECT token, {step(rules)} AS w FROM w{i})"
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    return out + (f", stems AS (SELECT token, CASE token {known} ELSE CASE WHEN length(token) <= 2 THEN token ELSE lower(w) END END AS stem "
                  f"FROM w{len(STEPS)})")


def stemmed_pairs_cte() -> str:
    """``stemmed``: the pairs with every token of more than three characters replaced by its stem."""
    side = lambda c: (f"(SELECT session_id, string_agg(CASE WHEN length(t.token) > 3 THEN stem ELSE t.token END, ' ' ORDER BY i) AS x "  # noqa: E731
                      f"FROM (SELECT session_id, unnest({overlap_tokens(c)}) AS token, generate_subscripts({overlap_tokens(c)}, 1) AS i FROM pairs) t "
                      "JOIN stems USING (token) GROUP BY session_id)")
    both = " UNION ALL ".join(f"SELECT unnest({overlap_tokens(c)}) AS token FROM pairs" for c in ("candidate", "reference"))
    return (f"{rouge_pairs_cte()}, {stem_ctes(both)}, stemmed AS (SELECT p.session_id, c.x AS candidate, r.x AS reference FROM pairs p "
            f"LEFT JOIN {side('candidate')} c USING (session_id) LEFT JOIN {side('reference')} r USING (session_id))")
