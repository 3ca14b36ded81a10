"""Registered queries over the provided tables, with their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` and runs the library's
operators over whole tables. Computed columns carry the same names in the
Spark result and in the SQL; doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import defaults as D
from ..operators import abbreviations as AB
from ..operators import lexicon as LX
from ..operators import linear as LN
from ..operators import report as R
from ..operators import sessions as S
from ..operators.sequence import number_rows, release_shared, shared
from ..operators import tiers as TR
from ..session import ensure_checkpoint_dir
from ..sources import pairs as PS
from ..sources import testdata as TD
from . import params as P
from . import sqlparts as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def query(spark, sf_dir):
            release_shared()  # what the query before has held
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def prepared(spark: SparkSession, sf_dir: str, reuse: bool = True) -> DataFrame:
    """Normalised utterances. Most queries read them several times; sharing
    keeps one normalisation pass per query. Single-pass queries take the plain
    plan, so their scans stay pruned to the columns they use."""
    pre = S.preprocess(TD.utterances(spark, sf_dir), role_keywords=P.ROLE_KEYWORDS)
    return shared(pre) if reuse else pre


# ---------------------------------------------------------------- phase 1: text

@register("normalize_utterances",
          f"WITH {Q.utt_cte()} SELECT session_id, turn, clean_text FROM utt")
def q_normalize(spark, sf_dir):
    return prepared(spark, sf_dir, reuse=False).select("session_id", "turn", "clean_text")


@register("assign_roles",
          f"WITH {Q.utt_cte()} SELECT session_id, turn, speaker, spk_role AS role FROM utt")
def q_roles(spark, sf_dir):
    return prepared(spark, sf_dir, reuse=False).select("session_id", "turn", "speaker", "role")


@register("sentence_split",
          f"WITH {Q.utt_cte()}, s AS (SELECT session_id, turn, {Q.split_sentences('clean_text')} AS sents FROM utt) "
          "SELECT session_id, turn, CAST(unnest(generate_series(0, len(sents) - 1)) AS INTEGER) AS sent_pos, "
          "unnest(sents) AS sentence FROM s")
def q_sentences(spark, sf_dir):
    return S.sentence_rows(prepared(spark, sf_dir, reuse=False))


@register("session_text",
          f"WITH {Q.utt_cte()}, {Q.session_text_cte()} SELECT session_id, session_text FROM st")
def q_session_text(spark, sf_dir):
    return S.session_text(prepared(spark, sf_dir))


@register("role_texts",
          f"WITH {Q.utt_cte()}, {Q.role_text_cte()} SELECT * FROM rt")
def q_role_texts(spark, sf_dir):
    return S.role_texts(prepared(spark, sf_dir))


@register("session_lengths",
          "SELECT conv_id AS session_id, count(text) AS n_utterances FROM conversations "
          "WHERE conv_id IS NOT NULL GROUP BY conv_id")
def q_lengths(spark, sf_dir):
    return S.session_lengths(TD.utterances(spark, sf_dir).filter(F.col("session_id").isNotNull()))


@register("length_histogram", """
WITH l AS (SELECT conv_id AS session_id, CAST(count(text) AS DOUBLE) AS n FROM conversations
           WHERE conv_id IS NOT NULL GROUP BY conv_id),
st AS (SELECT min(n) AS mn, max(n) AS mx, avg(n) AS mean FROM l),
b AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi, mean FROM st),
c AS (SELECT least(CAST(floor((n - lo) * 10 / (hi - lo)) AS INTEGER), 9) AS bin, count(*) AS n
      FROM l CROSS JOIN b GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
SELECT g.bin, round(lo + g.bin * ((hi - lo) / 10), 6) AS bin_lo,
       round(CASE WHEN g.bin = 9 THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / 10) END, 6) AS bin_hi,
       coalesce(c.n, 0) AS n, round(mean, 6) AS mean
FROM g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin""")
def q_histogram(spark, sf_dir):
    h = S.histogram(q_lengths(spark, sf_dir), "n_utterances", 10)
    return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n",
                    r6("mean").alias("mean"))


@register("corpus_profile",
          "SELECT count(*) AS n_utterances, count(DISTINCT conv_id) AS n_sessions FROM conversations "
          "WHERE conv_id IS NOT NULL")
def q_profile(spark, sf_dir):
    return S.corpus_profile(TD.utterances(spark, sf_dir).filter(F.col("session_id").isNotNull()))


# ---------------------------------------------------------------- phase 2: tiers, report

@register("lexicon_tier",
          f"WITH {Q.utt_cte()}, {Q.role_text_cte()} "
          f"SELECT session_id, {Q.lexicon_case('combined_text')} AS emotion_tier FROM rt")
def q_lexicon_tier(spark, sf_dir):
    return TR.lexicon_tiers(prepared(spark, sf_dir), P.LEXICON)


@register("session_tier",
          f"WITH {Q.utt_cte()}, {Q.role_text_cte()}, "
          f"t AS (SELECT session_id, {Q.lexicon_case('combined_text')} AS emotion_tier FROM rt) "
          f"SELECT session_id, emotion_tier, {Q.tier_label('emotion_tier')} AS tier_label, "
          "CASE WHEN emotion_tier > 1 THEN 'lexicon' ELSE 'default' END AS source FROM t")
def q_session_tier(spark, sf_dir):
    return TR.session_tiers(prepared(spark, sf_dir), P.LEXICON)


@register("tier_from_probabilities", """
WITH e AS (SELECT vec_id // 2 AS pair_id, vec_id % 2 AS side,
                  list_transform(embedding[1:32], lambda v: exp(CAST(v AS DOUBLE) * 10.0)) AS ex
           FROM embeddings),
p AS (SELECT pair_id, side, list_transform(ex, lambda v: v / list_sum(ex)) AS probs FROM e),
b AS (SELECT c.pair_id, list_transform(list_zip(c.probs, k.probs), lambda z: 0.7 * z[1] + 0.30000000000000004 * z[2]) AS bl
      FROM p c JOIN p k ON c.pair_id = k.pair_id AND c.side = 0 AND k.side = 1),
s AS (SELECT pair_id, bl[15] + bl[16] + bl[25] + bl[26] AS crisis,
             list_sum(bl[15:32]) AS neg FROM b)
SELECT pair_id, round(crisis, 6) AS crisis_score, round(neg, 6) AS negative_score,
       CASE WHEN crisis > 0.35 THEN 5 WHEN neg > 0.7 THEN 4 WHEN neg > 0.5 THEN 3 WHEN neg > 0.3 THEN 2 ELSE 1 END
         AS emotion_tier
FROM s""")
def q_prob_tier(spark, sf_dir):
    probs = TD.class_probabilities(spark, sf_dir, P.SOFTMAX_SCALE)
    return (TR.probability_tiers(probs)
            .select("pair_id", r6("crisis_score").alias("crisis_score"),
                    r6("negative_score").alias("negative_score"), "emotion_tier"))


def _routed_sql() -> str:
    case = Q.section_case("sentence")
    return (f"WITH {Q.utt_cte()}, {Q.session_text_cte('st', 'summary')}, "
            f"s AS (SELECT session_id, {Q.split_sentences('summary')} AS sents FROM st), "
            "x AS (SELECT session_id, CAST(unnest(generate_series(0, len(sents) - 1)) AS INTEGER) AS sent_pos, "
            "unnest(sents) AS sentence FROM s), "
            f"r AS (SELECT session_id, sent_pos, sentence, {case} AS m FROM x)")


@register("route_sentences",
          _routed_sql() + f" SELECT session_id, sent_pos, sentence, coalesce(m, {Q.lit(P.FALLBACK)}) AS section, "
          "m IS NOT NULL AS matched FROM r")
def q_route(spark, sf_dir):
    return R.route_sentences(None, "summary", P.SECTION_RULES, P.FALLBACK,
                             sentences=S.session_sentences(prepared(spark, sf_dir)))


def _report_sql() -> str:
    names = [n for n, _ in P.SECTION_RULES]
    cols = ", ".join(
        f"coalesce(max(CASE WHEN section = {Q.lit(n)} THEN txt END), 'Not identified in this session.') "
        f"AS {R.section_column(n)}" for n in names)
    return (_routed_sql()
            + f", ps AS (SELECT session_id, coalesce(m, {Q.lit(P.FALLBACK)}) AS section, "
            "string_agg(sentence, ' ' ORDER BY (m IS NULL)::INTEGER, sent_pos) AS txt FROM r GROUP BY 1, 2), "
            f"{Q.role_text_cte()}, "
            f"t AS (SELECT session_id, {Q.lexicon_case('combined_text')} AS emotion_tier FROM rt), "
            f"w AS (SELECT st.session_id, {cols} FROM st LEFT JOIN ps ON st.session_id = ps.session_id "
            "GROUP BY st.session_id) "
            f"SELECT w.*, coalesce(t.emotion_tier, 0) AS tier_score, "
            f"coalesce({Q.tier_label('t.emotion_tier')}, '') AS tier_label "
            "FROM w LEFT JOIN t ON w.session_id = t.session_id")


@register("session_report", _report_sql())
def q_report(spark, sf_dir):
    pre = prepared(spark, sf_dir)
    feats = TR.session_tiers(pre, P.LEXICON)
    return R.build_reports(feats.select("session_id"), feats, "summary", P.SECTION_RULES, P.FALLBACK,
                           sentences=S.session_sentences(pre))


# ---------------------------------------------------------------- phase 3: segmentation

from ..operators import segment as G  # noqa: E402


def segmented(spark, sf_dir, threshold=P.SEGMENT_THRESHOLD):
    return G.segment_sessions(prepared(spark, sf_dir), threshold)


@register("session_tfidf",
          f"WITH {Q.utt_cte()}, {Q.tfidf_ctes()} SELECT session_id, turn, term, round(w, 6) AS weight FROM wt")
def q_tfidf(spark, sf_dir):
    return G.tfidf(prepared(spark, sf_dir)).withColumn("weight", r6("weight"))


@register("adjacent_similarity",
          f"WITH {Q.utt_cte()}, {Q.similarity_ctes()} SELECT session_id, turn, round(similarity, 6) AS similarity FROM sim")
def q_similarity(spark, sf_dir):
    return G.adjacent_similarity(prepared(spark, sf_dir)).withColumn("similarity", r6("similarity"))


@register("segment_sessions",
          f"WITH {Q.utt_cte()}, {Q.segment_ctes(P.SEGMENT_THRESHOLD)} SELECT session_id, turn, segment_id FROM seg")
def q_segments(spark, sf_dir):
    return segmented(spark, sf_dir).select("session_id", "turn", "segment_id")


@register("segment_sessions_default",
          f"WITH {Q.utt_cte()}, {Q.segment_ctes(0.75)} SELECT session_id, turn, segment_id FROM seg")
def q_segments_default(spark, sf_dir):
    return segmented(spark, sf_dir, 0.75).select("session_id", "turn", "segment_id")


@register("segment_text",
          f"WITH {Q.utt_cte()}, {Q.segment_ctes(P.SEGMENT_THRESHOLD)} SELECT session_id, segment_id, "
          "string_agg(clean_text, ' ' ORDER BY turn) AS segment_text FROM seg GROUP BY session_id, segment_id")
def q_segment_text(spark, sf_dir):
    return G.segment_text(segmented(spark, sf_dir))


@register("top_terms",
          f"WITH {Q.utt_cte()}, {Q.top_terms_ctes(P.SEGMENT_THRESHOLD)} SELECT * FROM tt")
def q_top_terms(spark, sf_dir):
    return G.top_terms(segmented(spark, sf_dir))


def _topics_ctes(k: int) -> str:
    """``topics``: the term lists of a session's ``k`` weightiest segments, over all segments."""
    return ("tp AS (SELECT session_id, segment_id, string_agg(term, ', ' ORDER BY rank) AS words, sum(n) AS weight "
            "FROM tt GROUP BY session_id, segment_id), "
            "tpk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, segment_id) "
            f"AS r FROM tp) WHERE r <= {k}), "
            "topics AS (SELECT session_id, string_agg(words, '; ' ORDER BY r) AS topics FROM tpk GROUP BY session_id)")


def _prompt_sql() -> str:
    return (f"WITH {Q.utt_cte()}, {Q.top_terms_ctes(P.SEGMENT_THRESHOLD)}, {Q.role_text_cte()}, "
            f"{_topics_ctes(3)}, "
            "head AS (SELECT session_id, substr(string_agg(clean_text, ' ' ORDER BY turn), 1, 3000) AS head "
            "FROM utt GROUP BY session_id), "
            f"t AS (SELECT session_id, {Q.tier_label(Q.lexicon_case('combined_text'))} AS tier_label FROM rt) "
            "SELECT h.session_id, 'summarize counseling session: [emotional_intensity: ' || "
            "coalesce(t.tier_label, 'Unknown') || '] [main_topics: ' || coalesce(tp.topics, '') || "
            "'] [transcript: ' || h.head || ']' AS prompt "
            "FROM head h LEFT JOIN t ON h.session_id = t.session_id "
            "LEFT JOIN topics tp ON h.session_id = tp.session_id")


@register("build_prompt", _prompt_sql())
def q_prompt(spark, sf_dir):
    pre = prepared(spark, sf_dir)
    seg = G.segment_sessions(pre, P.SEGMENT_THRESHOLD)
    topics = G.segment_topics(G.top_terms(seg), n_topics=3)
    feats = TR.session_tiers(pre, P.LEXICON).join(topics, "session_id", "left")
    return S.build_prompts(pre, feats)


# ---------------------------------------------------------------- phase 4: evaluation

from ..operators import evaluate as EV  # noqa: E402

# The texts compared are those of whole sessions, and named for what they are:
# a role's turns against the other role's, or against the whole session.
LIVE_MODELS = {"Counselor turns": "counselor", "Client turns": "client"}


def rouge_pairs(spark, sf_dir):
    """Candidate: all counselor turns; reference: all client turns; of sessions that have both."""
    rt = S.role_texts(prepared(spark, sf_dir, reuse=False))
    return (rt.filter("client_text <> '' AND counselor_text <> ''")
            .select("session_id", F.col("counselor_text").alias("candidate"), F.col("client_text").alias("reference")))


def _rounded(df, cols=("precision", "recall", "f1")):
    for c in cols:
        df = df.withColumn(c, r6(c))
    return df


@register("rouge_1", f"WITH {Q.rouge_pairs_cte()} SELECT session_id, round(precision, 6) AS precision, "
          f"round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {Q.rouge_n_select(1)}")
def q_rouge1(spark, sf_dir):
    return _rounded(EV.rouge_n(rouge_pairs(spark, sf_dir), 1))


@register("rouge_2", f"WITH {Q.rouge_pairs_cte()} SELECT session_id, round(precision, 6) AS precision, "
          f"round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {Q.rouge_n_select(2)}")
def q_rouge2(spark, sf_dir):
    return _rounded(EV.rouge_n(rouge_pairs(spark, sf_dir), 2))


@register("rouge_1_stemmed", f"WITH {Q.stemmed_pairs_cte()} SELECT session_id, round(precision, 6) AS precision, "
          f"round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {Q.rouge_n_select(1, 'stemmed')}")
def q_rouge1_stemmed(spark, sf_dir):
    pairs = rouge_pairs(spark, sf_dir)
    return _rounded(EV.rouge_n(pairs, 1, token_table=EV.pair_stems(pairs)))


@register("rouge_l", f"WITH {Q.rouge_pairs_cte()} SELECT session_id, round(precision, 6) AS precision, "
          f"round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {Q.rouge_l_select()}")
def q_rougel(spark, sf_dir):
    return _rounded(EV.rouge_l(rouge_pairs(spark, sf_dir)))


@register("rouge_l_tiles", f"WITH {Q.rouge_pairs_cte()} SELECT session_id, round(precision, 6) AS precision, "
          f"round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {Q.rouge_l_select()}")
def q_rougel_tiles(spark, sf_dir):
    return _rounded(EV.rouge_l(rouge_pairs(spark, sf_dir), tile=P.LCS_TILE))


def model_predictions(spark, sf_dir):
    rt = S.role_texts(prepared(spark, sf_dir))
    both = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{role}_text").alias("prediction"))
                     for m, role in LIVE_MODELS.items()])
    return rt.select("session_id", F.explode(both).alias("x")).select("session_id", "x.prediction", "x.model").filter(
        "prediction <> ''")


def model_references(spark, sf_dir):
    return S.session_text(prepared(spark, sf_dir), out="reference")


def _role_models_sql() -> str:
    """CTEs ending in ``mp``: the roles' texts against the whole session."""
    preds = " UNION ALL ".join(
        f"SELECT {Q.lit(m)} AS model, session_id, {r}_text AS candidate FROM rt WHERE {r}_text <> ''"
        for m, r in LIVE_MODELS.items())
    return (f"{Q.utt_cte()}, {Q.role_text_cte()}, {Q.session_text_cte('st', 'reference')}, preds AS ({preds}), "
            "mp AS (SELECT p.model, p.session_id, p.candidate, r.reference FROM preds p "
            "JOIN st r ON p.session_id = r.session_id)")


def _scores_sql(metrics) -> str:
    """A CTE ``live``: the metrics' means over the pairs ``mp``."""
    one = {"ROUGE-1": Q.rouge_n_select(1, "mp", "model, session_id"), "ROUGE-2": Q.rouge_n_select(2, "mp", "model, session_id"),
           "ROUGE-L": Q.rouge_l_select("mp", "model, session_id")}
    every = " UNION ALL ".join(f"SELECT {Q.lit(m)} AS metric, model, session_id, f1 FROM {one[m]}" for m in metrics)
    return (f"live AS (SELECT model, metric, round(avg(f1) * 100, 1) AS value, count(*) AS n_pairs FROM ({every}) "
            "GROUP BY model, metric)")


@register("model_comparison", f"WITH {_role_models_sql()}, {_scores_sql(('ROUGE-1', 'ROUGE-2'))} "
          "SELECT model, metric, value, n_pairs FROM live")
def q_models(spark, sf_dir):
    return EV.evaluate_models(model_references(spark, sf_dir), model_predictions(spark, sf_dir),
                              metrics=("ROUGE-1", "ROUGE-2"))


@register("model_comparison_lcs", f"WITH {_role_models_sql()}, {_scores_sql(('ROUGE-L',))} "
          "SELECT model, metric, value, n_pairs FROM live")
def q_models_lcs(spark, sf_dir):
    return EV.evaluate_models(model_references(spark, sf_dir), model_predictions(spark, sf_dir),
                              metrics=("ROUGE-L",))


@register("embedding_match", """
WITH e AS (SELECT vec_id, vec_id // 64 AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT * FROM e WHERE vec_id % 2 = 0), r AS (SELECT * FROM e WHERE vec_id % 2 = 1),
cr AS (SELECT c.label, c.vec_id AS cid, r.vec_id AS rid, list_cosine_similarity(c.v, r.v) AS s
       FROM c JOIN r ON c.label = r.label),
p AS (SELECT label, avg(m) AS precision FROM (SELECT label, cid, max(s) AS m FROM cr GROUP BY label, cid) GROUP BY label),
q AS (SELECT label, avg(m) AS recall FROM (SELECT label, rid, max(s) AS m FROM cr GROUP BY label, rid) GROUP BY label)
SELECT p.label AS pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1
FROM p JOIN q ON p.label = q.label""")
def q_embedding_match(spark, sf_dir):
    e = TD.table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 64).alias("pair_id"), F.col("vec_id").alias("token_id"), F.col("embedding").alias("vector"),
        (F.col("vec_id") % 2).alias("side"))
    return _rounded(EV.embedding_match(e.filter("side = 0"), e.filter("side = 1")))


def _tier_metric_ctes() -> str:
    """CTEs ending in ``m(tier, pre, rec, f1v, tt)``: per-tier metrics of the
    lexicon tier (role order) against the lexicon tier of the session text."""
    return (f"WITH {Q.utt_cte()}, {Q.role_text_cte()}, {Q.session_text_cte()}, "
            f"pr AS (SELECT {Q.lexicon_case('st.session_text')} AS t, {Q.lexicon_case('rt.combined_text')} AS p "
            "FROM st JOIN rt ON st.session_id = rt.session_id), "
            "lab AS (SELECT unnest([1, 2, 3, 4, 5]) AS tier), "
            "c AS (SELECT tier, CAST(sum(CASE WHEN t = tier AND p = tier THEN 1 ELSE 0 END) AS DOUBLE) AS tp, "
            "sum(CASE WHEN p = tier THEN 1 ELSE 0 END) AS pp, sum(CASE WHEN t = tier THEN 1 ELSE 0 END) AS tt "
            "FROM lab CROSS JOIN pr GROUP BY tier), "
            "m0 AS (SELECT tier, coalesce(tp / nullif(pp, 0), 0.0) AS pre, coalesce(tp / nullif(tt, 0), 0.0) AS rec, "
            "tt FROM c), "
            "m AS (SELECT *, CASE WHEN pre + rec > 0 THEN 2 * pre * rec / (pre + rec) ELSE 0 END AS f1v FROM m0)")


def _tier_metrics_sql() -> str:
    return (_tier_metric_ctes() + " SELECT tier, round(pre, 6) AS precision, round(rec, 6) AS recall, "
            "round(f1v, 6) AS f1, CAST(tt AS BIGINT) AS support FROM m")


def _tier_leaderboard_sql() -> str:
    return (_tier_metric_ctes() + ", w AS (SELECT sum(f1v * tt) / sum(tt) AS wf FROM m) "
            "SELECT tier, round(pre, 6) AS precision, round(rec, 6) AS recall, round(f1v, 6) AS f1, "
            "'live' AS source, round(wf, 6) AS weighted_f1, wf >= 0.83 AS meets_target FROM m CROSS JOIN w")


@register("tier_metrics", _tier_metrics_sql())
def q_tier_metrics(spark, sf_dir):
    pre = prepared(spark, sf_dir)
    feats = TR.session_tiers(pre, P.LEXICON)
    return _rounded(EV.evaluate_tiers(feats, pre, P.LEXICON))


@register("training_log_rollup", """
WITH l AS (SELECT event_id AS seq, hour(ts) / CAST(6.0 AS DOUBLE) AS epoch,
                  CASE WHEN event_type = 'click' THEN value END AS loss,
                  CASE WHEN event_type = 'view' THEN value END AS eval_loss FROM events),
tr AS (SELECT CAST(round_even(epoch, 0) AS BIGINT) AS epoch, avg(loss) AS train_loss FROM l
       WHERE loss IS NOT NULL AND epoch IS NOT NULL GROUP BY 1),
va AS (SELECT CAST(round_even(epoch, 0) AS BIGINT) AS epoch, arg_max(eval_loss, seq) AS eval_loss FROM l
       WHERE eval_loss IS NOT NULL AND epoch IS NOT NULL GROUP BY 1)
SELECT tr.epoch, round(train_loss, 6) AS train_loss, round(eval_loss, 6) AS eval_loss
FROM tr JOIN va ON tr.epoch = va.epoch""")
def q_training_log(spark, sf_dir):
    out = EV.rollup_training_log(TD.trainer_log(spark, sf_dir))
    return out.select("epoch", r6("train_loss").alias("train_loss"), r6("eval_loss").alias("eval_loss"))


# ---------------------------------------------------------------- phase 5: data preparation

from ..operators import prepare as PR  # noqa: E402
from ..sources import annotated as AN  # noqa: E402


@register("meta_split", f"WITH {Q.annotated_cte()} SELECT session_id, row_pos, is_meta FROM annm")
def q_meta_split(spark, sf_dir):
    return AN.split_meta_rows(TD.annotated_rows(spark, sf_dir)).select("session_id", "row_pos", "is_meta")


@register("session_reference", f"WITH {Q.annotated_cte()} SELECT session_id, reference_summary FROM refs_ok")
def q_session_reference(spark, sf_dir):
    return AN.session_reference(TD.annotated_rows(spark, sf_dir))


@register("speaker_code", f"WITH {Q.annotated_cte()} SELECT session_id, turn, speaker, utterance FROM autt")
def q_speaker_code(spark, sf_dir):
    return AN.annotated_to_utterances(TD.annotated_rows(spark, sf_dir))


@register("session_transcripts",
          f"WITH {Q.annotated_cte()} SELECT session_id, transcript, reference_summary FROM sess")
def q_transcripts(spark, sf_dir):
    return AN.load_sessions(TD.annotated_rows(spark, sf_dir))[1]


def qa_pairs(spark, sf_dir):
    u = TD.utterances(spark, sf_dir)
    q = u.filter(F.col("speaker") == "user").select("session_id", "turn", F.col("utterance").alias("transcript"))
    a = u.filter(F.col("speaker") == "assistant").select(
        "session_id", (F.col("turn") - 1).alias("turn"), F.col("utterance").alias("reference_summary"))
    qa = PS.filter_short(q.join(a, ["session_id", "turn"]), "reference_summary", 100)
    return qa.select(F.concat_ws(":", F.col("session_id").cast("string"), F.col("turn").cast("string"))
                     .alias("pair_key"), "session_id", "transcript", "reference_summary")


def training_pair_table(spark, sf_dir):
    _, sessions = AN.load_sessions(TD.annotated_rows(spark, sf_dir))
    return PR.training_pairs(sessions, qa_pairs(spark, sf_dir))


@register("training_pairs",
          f"WITH {Q.pairs_cte()} SELECT source_rank, pair_key, transcript, reference_summary FROM tpn")
def q_training_pairs(spark, sf_dir):
    return training_pair_table(spark, sf_dir).drop("session_id")


@register("split_by_session",
          f"WITH {Q.pairs_cte()} SELECT source_rank, pair_key, CASE WHEN CAST('0x' || substr(md5('42:' || "
          "split_part(pair_key, ':', 1)), 1, 8) AS BIGINT) % 10000 < 8000 THEN 'train' ELSE 'validation' END AS split "
          "FROM tpn")
def q_split_by_session(spark, sf_dir):
    return PR.split_pairs(training_pair_table(spark, sf_dir), 0.8, by="session").select("source_rank", "pair_key", "split")


@register("split_pairs",
          f"WITH {Q.pairs_cte()} SELECT source_rank, pair_key, CASE WHEN row_number() OVER "
          "(ORDER BY source_rank, pair_key) - 1 < floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'validation' END "
          "AS split FROM tpn")
def q_split_pairs(spark, sf_dir):
    return PR.split_pairs(training_pair_table(spark, sf_dir), 0.8).select("source_rank", "pair_key", "split")


@register("label_encode",
          f"SELECT event_id AS row_id, event_type AS emotion, {Q.encode_label('event_type', P.EVENT_LABELS)} "
          "AS label_id FROM events WHERE props IS NOT NULL")
def q_label_encode(spark, sf_dir):
    return (PR.encode_labels(TD.labelled_text(spark, sf_dir), labels=P.EVENT_LABELS)
            .select("row_id", "emotion", "label_id"))


@register("split_labelled",
          f"SELECT event_id AS row_id, {Q.encode_label('event_type', P.EVENT_LABELS)} AS label_id, "
          "CASE WHEN row_number() OVER (ORDER BY event_id) - 1 < floor(0.9 * count(*) OVER ()) "
          "THEN 'train' ELSE 'validation' END AS split FROM events WHERE props IS NOT NULL")
def q_split_labelled(spark, sf_dir):
    enc = PR.encode_labels(TD.labelled_text(spark, sf_dir), labels=P.EVENT_LABELS)
    return S.positional_split(enc, ["row_id"], 0.9).select("row_id", "label_id", "split")


@register("quick_subset",
          "SELECT conv_id AS session_id, turn, role AS speaker, text AS utterance FROM conversations "
          "WHERE conv_id IN (SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id "
          "ORDER BY min(turn), conv_id LIMIT 3)")
def q_quick_subset(spark, sf_dir):
    return S.quick_subset(TD.utterances(spark, sf_dir).filter(F.col("session_id").isNotNull()))


# ---------------------------------------------------------------- phase 6: graph, ranking, models

from ..operators import extract as X  # noqa: E402
from ..operators.extract import lead_sentence_generator  # noqa: E402


def _graph_sql() -> str:
    return (f"WITH {Q.utt_cte()}, {Q.graph_ctes()} "
            "SELECT wl.session_id, wl.sent_pos, wl.l AS n_words, round(coalesce(sum(e.w), 0.0), 6) AS degree "
            "FROM wl LEFT JOIN e ON e.session_id = wl.session_id AND e.i = wl.sent_pos "
            "GROUP BY wl.session_id, wl.sent_pos, wl.l")


@register("sentence_graph", _graph_sql())
def q_sentence_graph(spark, sf_dir):
    sents = S.session_sentences(prepared(spark, sf_dir))
    sents = shared(sents.withColumn("n_words", F.size(X.T.graph_words("sentence")).cast("long")))
    return X.sentence_graph(sents).withColumn("degree", r6("degree"))


@register("textrank_summary", f"WITH RECURSIVE {Q.utt_cte()}, {Q.textrank_ctes()} SELECT session_id, generated_summary FROM tr")
def q_textrank(spark, sf_dir):
    return X.summarize_sessions(prepared(spark, sf_dir))


from ..operators import classify as CL  # noqa: E402
from ..operators import topics as TP  # noqa: E402
from . import pipeline as PL  # noqa: E402


@register("session_topics")
def q_session_topics(spark, sf_dir):
    docs = G.segment_text(segmented(spark, sf_dir))
    return TP.session_topics(docs).withColumn("words", F.array_join("words", ", "))


def language_classifier(spark, sf_dir):
    docs = TD.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("utterance"),
                                                       F.col("lang").alias("emotion"))
    return CL.fit_label_classifier(docs, labels=P.LANG_LABELS, order=["doc_id"], max_iter=10,
                                   num_features=1 << 16)


@register("label_classifier")
def q_label_classifier(spark, sf_dir):
    docs = TD.table(spark, sf_dir, "documents").join(TD.table(spark, sf_dir, "labels"), "doc_id")
    docs = docs.select("doc_id", F.col("text").alias("utterance"), F.col("quality").cast("string").alias("emotion"))
    model, split = CL.fit_label_classifier(docs, labels=["0", "1"], order=["doc_id"], max_iter=10,
                                         num_features=1 << 16)
    return (model.transform(split)
            .select("doc_id", "split", F.col("label_id").cast("int").alias("label_id"),
                    F.col("prediction").cast("int").alias("prediction")))


def _quality_rows() -> str:
    return ("qrows AS (SELECT d.doc_id AS key, d.text, CAST(l.quality AS VARCHAR) AS label, "
            "row_number() OVER (ORDER BY d.doc_id) - 1 < floor(0.9 * count(*) OVER ()) AS trains "
            "FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL), "
            "train AS (SELECT label, text FROM qrows WHERE trains)")


@register("label_classifier_relational",
          f"WITH {_quality_rows()}, {Q.bayes_ctes('train', 'qrows', ['0', '1'])} "
          "SELECT qrows.key AS doc_id, CASE WHEN trains THEN 'train' ELSE 'validation' END AS split, qrows.label, "
          "arg_max(pb.label, (pb.p, -pb.place)) AS prediction, round(max(CASE WHEN pb.label = '1' THEN pb.p END), 6) AS probability "
          "FROM qrows JOIN pb ON pb.key = qrows.key GROUP BY ALL")
def q_label_classifier_relational(spark, sf_dir):
    docs = TD.table(spark, sf_dir, "documents").join(TD.table(spark, sf_dir, "labels"), "doc_id")
    rows = docs.where("quality IS NOT NULL").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    split = shared(S.positional_split(rows, ["doc_id"], 0.9))
    model = LN.fit_bayes(split.where("split = 'train'"), "text", "label", ["0", "1"])
    probs = model.probabilities(split, ["doc_id"], "text")
    best = F.array_position("probs", F.array_max("probs")).cast("int")
    return split.join(probs, "doc_id").select(
        "doc_id", "split", "label", F.element_at(F.array(F.lit("0"), F.lit("1")), best).alias("prediction"),
        r6(F.element_at("probs", 2)).alias("probability"))


def _tier_relational_sql() -> str:
    """The lexicon first; what it leaves, by naive Bayes of the role texts."""
    weigh = lambda idx: f"sum(CASE WHEN place IN ({', '.join(map(str, idx))}) THEN w * p ELSE 0 END)"
    return (f"WITH {Q.utt_cte()}, {Q.role_text_cte()}, train AS (SELECT lang AS label, text FROM documents), "
            f"lx AS (SELECT *, {Q.lexicon_case('combined_text')} AS tier FROM rt), "
            "sides AS (SELECT session_id || '|0' AS key, session_id, 0.7 AS w, client_text AS text FROM lx WHERE tier <= 1 "
            "UNION ALL SELECT session_id || '|1', session_id, 0.30000000000000004, counselor_text FROM lx WHERE tier <= 1), "
            f"{Q.bayes_ctes('train', 'sides', P.LANG_LABELS)}, "
            f"bl AS (SELECT session_id, {weigh(D.CRISIS_IDX)} AS crisis, {weigh(D.NEGATIVE_IDX)} AS neg FROM sides "
            "JOIN pb ON pb.key = sides.key WHERE trim(sides.text) <> '' GROUP BY session_id), "
            "t AS (SELECT lx.session_id, CASE WHEN tier > 1 THEN tier WHEN crisis > 0.35 THEN 5 WHEN neg > 0.7 THEN 4 "
            "WHEN neg > 0.5 THEN 3 WHEN neg > 0.3 THEN 2 ELSE 1 END AS emotion_tier, "
            "CASE WHEN tier > 1 THEN 'lexicon' ELSE 'model' END AS source FROM lx LEFT JOIN bl ON bl.session_id = lx.session_id) "
            f"SELECT session_id, emotion_tier, {Q.tier_label('emotion_tier')} AS tier_label, source FROM t")


@register("session_tier_relational", _tier_relational_sql())
def q_session_tier_relational(spark, sf_dir):
    docs = TD.table(spark, sf_dir, "documents")
    model = LN.fit_bayes(docs, "text", "lang", P.LANG_LABELS)
    return TR.session_tiers(prepared(spark, sf_dir), P.LEXICON, model=model)


@register("session_tier_model")
def q_session_tier_model(spark, sf_dir):
    model, _ = language_classifier(spark, sf_dir)
    return TR.session_tiers(prepared(spark, sf_dir), P.LEXICON, model=model)


@register("session_features",
          f"WITH {Q.utt_cte()}, {Q.top_terms_ctes(P.SEGMENT_THRESHOLD)}, {Q.role_text_cte()}, {_topics_ctes(8)}, "
          f"t AS (SELECT session_id, {Q.lexicon_case('combined_text')} AS emotion_tier FROM rt) "
          f"SELECT t.session_id, t.emotion_tier, {Q.tier_label('t.emotion_tier')} AS tier_label, "
          "coalesce(topics.topics, '') AS topics FROM t LEFT JOIN topics ON t.session_id = topics.session_id")
def q_session_features(spark, sf_dir):
    pre = prepared(spark, sf_dir)
    feats = PL.extract_features(pre, G.segment_sessions(pre, P.SEGMENT_THRESHOLD), P.LEXICON, topic_method="terms")
    return feats.select("session_id", "emotion_tier", "tier_label",
                        F.array_join(F.transform("topics", lambda t: F.array_join(t, ", ")), "; ").alias("topics"))


@register("pipeline_report")
def q_pipeline_report(spark, sf_dir):
    res = PL.run(TD.utterances(spark, sf_dir), lexicon=P.LEXICON, rules=P.SECTION_RULES, fallback=P.FALLBACK,
                 threshold=P.SEGMENT_THRESHOLD, topic_method="terms", role_keywords=P.ROLE_KEYWORDS)
    return res["reports"]


@register("normalize_repaired")
def q_normalize_repaired(spark, sf_dir):
    pre = S.preprocess(TD.utterances(spark, sf_dir), role_keywords=P.ROLE_KEYWORDS, mode="repaired")
    return pre.select("session_id", "turn", "clean_text")


@register("generator_summaries")
def q_generator_summaries(spark, sf_dir):
    pre = prepared(spark, sf_dir)
    prompts = S.build_prompts(pre, TR.session_tiers(pre, P.LEXICON).withColumn(
        "topics", F.array().cast("array<array<string>>")))
    return X.summarize_sessions(pre, generator=lead_sentence_generator, prompts=prompts)


@register("tier_leaderboard", _tier_leaderboard_sql())
def q_tier_leaderboard(spark, sf_dir):
    pre = prepared(spark, sf_dir)
    live = EV.evaluate_tiers(TR.session_tiers(pre, P.LEXICON), pre, P.LEXICON)
    out = EV.tier_leaderboard(EV.published_tier_scores(spark), live)
    return _rounded(out, ("precision", "recall", "f1", "weighted_f1"))


@register("sample_labelled",
          f"SELECT event_id AS row_id, event_type AS emotion, {Q.encode_label('event_type', P.EVENT_LABELS)} AS label_id "
          "FROM events WHERE props IS NOT NULL ORDER BY md5('42:' || CAST(event_id AS VARCHAR)) LIMIT 500")
def q_sample_labelled(spark, sf_dir):
    enc = PR.encode_labels(TD.labelled_text(spark, sf_dir), labels=P.EVENT_LABELS)
    return S.sample_rows(enc, 500, key=["row_id"]).select("row_id", "emotion", "label_id")


#: The published model that ``summarize_sessions`` is.
TEXTRANK_MODEL = "TF-IDF TextRank"


def _textrank_scores_sql() -> str:
    """CTEs ending in ``live``: the summaries against the whole session."""
    return (f"{Q.utt_cte()}, {Q.textrank_ctes()}, mp AS (SELECT {Q.lit(TEXTRANK_MODEL)} AS model, tr.session_id, "
            "tr.generated_summary AS candidate, st.summary AS reference FROM tr JOIN st ON tr.session_id = st.session_id), "
            + _rouge_and_match_sql())


def _rouge_and_match_sql() -> str:
    """A CTE ``live`` with ROUGE and the embedding match of ``mp``."""
    side = lambda c: (f"(SELECT model, session_id, w, count(*) AS n FROM (SELECT model, session_id, unnest({Q.overlap_tokens(c)}) AS w "  # noqa: E731
                      "FROM mp) GROUP BY model, session_id, w)")
    best = lambda a, b: (f"SELECT model, session_id, sum(n * m) / sum(n) AS s FROM (SELECT {a}.model, {a}.session_id, {a}.w, any_value({a}.n) AS n, "  # noqa: E731
                         f"max(list_cosine_similarity(va.v, vb.v)) AS m FROM {a} JOIN {b} ON {a}.model = {b}.model AND {a}.session_id = {b}.session_id "
                         f"JOIN vec va ON va.w = {a}.w JOIN vec vb ON vb.w = {b}.w GROUP BY {a}.model, {a}.session_id, {a}.w) GROUP BY model, session_id")
    return (f"ct AS MATERIALIZED {side('candidate')}, rf AS MATERIALIZED {side('reference')}, "
            "size AS (SELECT count(*) AS k FROM embeddings), "
            "num AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
            "vec AS MATERIALIZED (SELECT w, v FROM (SELECT w, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % k AS place "
            "FROM (SELECT w FROM ct UNION SELECT w FROM rf), size) JOIN num USING (place)), "
            f"ep AS ({best('ct', 'rf')}), er AS ({best('rf', 'ct')}), "
            "em AS (SELECT ep.model, ep.session_id, CASE WHEN ep.s + er.s > 0 THEN 2 * ep.s * er.s / (ep.s + er.s) ELSE 0 END AS f1 "
            "FROM ep JOIN er ON ep.model = er.model AND ep.session_id = er.session_id), "
            + _scores_sql(("ROUGE-1", "ROUGE-2", "ROUGE-L")).replace("live AS", "rouge AS")
            + ", live AS (SELECT * FROM rouge UNION ALL SELECT model, 'BERTScore F1', round(avg(f1), 3), count(*) FROM em GROUP BY model)")


def vector_places(spark, sf_dir):
    """``place, vector``: the rows of ``embeddings`` numbered in the order of ids."""
    rows = TD.table(spark, sf_dir, "embeddings")
    place = number_rows(rows.select(F.lit(0).alias("all"), "vec_id", "embedding"), ["all"], "vec_id", out="place")
    return place.select("place", F.col("embedding").alias("vector"))


def token_places(spark, sf_dir, texts, keys, text):
    """Distinct tokens of texts with their counts and the places of their vectors. As no encoder is at hand, a token's
    vector is that row of ``embeddings`` (see ``vector_places``) which its MD5 names."""
    tokens = (texts.select(*keys, F.explode(X.T.overlap_tokens(text)).alias("token_id")).groupBy(*keys, "token_id")
              .agg(F.count("*").alias("weight")))
    number = F.conv(F.substring(F.md5(F.col("token_id").cast("binary")), 1, 8), 16, 10).cast("long")
    count = TD.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("k")).select("k").scalar()
    return tokens.select(*keys, F.xxhash64("token_id").alias("token_id"), (number % count).alias("place"), "weight")


@register("textrank_scores", f"WITH RECURSIVE {_textrank_scores_sql()} SELECT model, metric, value, n_pairs FROM live")
def q_textrank_scores(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    summaries = X.summarize_sessions(prepared(spark, sf_dir))
    preds = summaries.select("session_id", F.col("generated_summary").alias("prediction")).withColumn("model", F.lit(TEXTRANK_MODEL))
    # a few sentences a session, so few bytes that they would come in one partition, which every reader keeps
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    preds = preds.repartition(n_parts, "session_id").checkpoint()
    refs = model_references(spark, sf_dir)
    vectors = (token_places(spark, sf_dir, preds, ["model", "session_id"], "prediction"),
               token_places(spark, sf_dir, refs, ["session_id"], "reference"), vector_places(spark, sf_dir))
    return EV.evaluate_models(refs, preds, token_vectors=vectors)


def _leaderboard_sql() -> str:
    rows = []
    for model, vals in D.PUBLISHED_ROUGE.items():
        for metric, v in zip(["ROUGE-1", "ROUGE-2", "ROUGE-L"], vals):
            rows.append(f"({Q.lit(model)}, {Q.lit(metric)}, CAST({float(v)!r} AS DOUBLE))")
    for model, v in D.PUBLISHED_BERTSCORE.items():
        rows.append(f"({Q.lit(model)}, 'BERTScore F1', CAST({float(v)!r} AS DOUBLE))")
    target = "CASE " + " ".join(f"WHEN metric = {Q.lit(m)} THEN CAST({float(t)!r} AS DOUBLE)"
                                for m, t in D.TARGETS.items()) + " END"
    return (f"WITH RECURSIVE {_textrank_scores_sql()}, pub(model, metric, value) AS (VALUES {', '.join(rows)}), "
            "j AS (SELECT coalesce(p.model, l.model) AS model, coalesce(p.metric, l.metric) AS metric, "
            "coalesce(l.value, p.value) AS value, CASE WHEN l.value IS NOT NULL THEN 'live' ELSE 'published' END "
            "AS source FROM pub p LEFT JOIN live l ON p.model = l.model AND p.metric = l.metric), "
            f"t AS (SELECT *, {target} AS target FROM j) "
            "SELECT model, metric, value, source, target, "
            "CAST(row_number() OVER (PARTITION BY metric ORDER BY value, model) AS INTEGER) AS position, "
            "CASE WHEN target IS NULL THEN NULL ELSE value >= target END AS meets_target FROM t")


@register("leaderboard", _leaderboard_sql())
def q_leaderboard(spark, sf_dir):
    """The published scores with those of the one published model that the library runs, TextRank,
    replaced by its scores on the sessions."""
    live = q_textrank_scores(spark, sf_dir)
    return EV.leaderboard(EV.published_scores(spark), live).withColumn("position", F.col("position").cast("int"))


# ---------------------------------------------------------------- gaps in turn, text rules on long documents

@register("segment_gapped",
          "WITH " + Q.gapped_utt_cte() + f", {Q.segment_ctes(P.SEGMENT_THRESHOLD)} "
          "SELECT seg.session_id, g.orig AS turn, segment_id FROM seg JOIN utt g ON g.session_id = seg.session_id AND g.turn = seg.turn")
def q_segment_gapped(spark, sf_dir):
    u = TD.utterances(spark, sf_dir).filter(F.col("speaker") != "system")
    pre = S.preprocess(u, role_keywords=P.ROLE_KEYWORDS)
    return G.segment_sessions(pre, P.SEGMENT_THRESHOLD).select("session_id", "turn", "segment_id")


def documents(spark, sf_dir):
    return TD.table(spark, sf_dir, "documents").select("doc_id", "text")


@register("normalize_documents",
          f"SELECT doc_id, {Q.normalize('text', P.DOCUMENT_FILLERS)} AS clean_text FROM documents")
def q_normalize_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.T.normalize_text("text", P.DOCUMENT_FILLERS).alias("clean_text"))


@register("sentence_split_documents",
          f"WITH s AS (SELECT doc_id, {Q.split_sentences('text')} AS sents FROM documents) "
          "SELECT doc_id, CAST(unnest(generate_series(0, len(sents) - 1)) AS INTEGER) AS sent_pos, "
          "unnest(sents) AS sentence FROM s")
def q_sentence_documents(spark, sf_dir):
    return S.sentence_rows(documents(spark, sf_dir), "text", ("doc_id",))


@register("abbreviation_statistics", """
WITH f AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9.]*')) AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT rtrim(w, '.') AS word, ends_with(w, '.') AS dot FROM f WHERE NOT ends_with(w, '..')),
c AS (SELECT word, count(*) FILTER (WHERE dot) AS n_dot, count(*) FILTER (WHERE NOT dot) AS n_plain FROM k GROUP BY word),
s AS (SELECT *, (SELECT count(*) FILTER (WHERE dot) / count(*) FROM k) AS p, length(replace(word, '.', '')) AS len FROM c WHERE n_dot > 0),
l AS (SELECT *, -2 * (n_dot * (ln(p) - ln(0.99)) + CASE WHEN n_plain > 0 THEN n_plain * (ln(1 - p) - ln(0.01)) ELSE 0 END) AS ll FROM s),
x AS (SELECT *, ll * exp(-len) * (length(word) - len + 1) * pow(CAST(len AS DOUBLE), -n_plain) AS score FROM l)
SELECT word, n_dot, n_plain, round(score, 6) + 0.0 AS score, score >= 0.3 AS abbreviation FROM x""")
def q_abbreviation_statistics(spark, sf_dir):
    return AB.abbreviation_statistics(documents(spark, sf_dir)).drop("log_likelihood").withColumn("score", r6("score") + 0.0)


@register("lexicon_tier_documents",
          f"SELECT doc_id, {Q.lexicon_case('text', P.default_lexicon())} AS emotion_tier FROM documents")
def q_lexicon_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.T.lexicon_tier("text").alias("emotion_tier"))


PHRASE_TIER = """CASE WHEN length({p}) % 16 = 0 THEN 5 WHEN length({p}) % 16 < 3 THEN 4 WHEN length({p}) % 16 < 7 THEN 3 ELSE 2 END"""


def phrase_table(docs: DataFrame) -> DataFrame:
    """A large lexicon as input: every 25th run of three words of a-z of each document, graded by its length."""
    phrases = TD.word_runs(docs, "text", 25).distinct()
    return phrases.withColumn("tier", F.expr(PHRASE_TIER.format(p="phrase")))


@register("lexicon_tier_large", f"""
WITH r AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z]+ [a-z]+ [a-z]+'), lambda x, i: i % 25 = 1) AS ps FROM documents),
p AS (SELECT DISTINCT unnest(ps) AS phrase FROM r),
lex AS (SELECT phrase, {PHRASE_TIER.format(p="phrase")} AS tier FROM p)
SELECT d.doc_id, CAST(coalesce(max(tier), 1) AS INTEGER) AS emotion_tier
FROM documents d LEFT JOIN lex ON contains(lower(coalesce(d.text, '')), phrase) GROUP BY d.doc_id""")
def q_lexicon_large(spark, sf_dir):
    """Whole documents against a lexicon of thousands of phrases, through the phrase index."""
    docs = TD.table(spark, sf_dir, "documents").select("doc_id", "text")
    return LX.indexed_lexicon_tiers(docs, phrase_table(docs), "doc_id")


# ---------------------------------------------------------------- file sources and the sink, on files of the given tables

@register("labelled_scan", "SELECT text AS utterance, lang AS emotion FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def q_labelled_scan(spark, sf_dir):
    """Documents and their languages, written as labelled CSV (line breaks inside quotes) and read back."""
    d = TD.table(spark, sf_dir, "documents").select(F.col("text").alias("Situation"), F.col("lang").alias("emotion"))
    return PS.read_labelled_text(spark, TD.csv_folder(d, "labelled"))


@register("pair_sources",
          "SELECT text AS transcript, source AS reference_summary, 2 AS source_rank FROM documents "
          "WHERE text IS NOT NULL AND source IS NOT NULL UNION ALL "
          "SELECT 'q' || doc_id, text, 1 FROM documents WHERE length(text) > 100")
def q_pair_sources(spark, sf_dir):
    """The union of a missing source, a question/answer CSV and a corpus export, each read from its files."""
    d = TD.table(spark, sf_dir, "documents")
    qa = TD.csv_folder(d.select(F.concat(F.lit("q"), "doc_id").alias("questionText"), F.col("text").alias("answerText")), "qa")
    corpus = TD.new_folder(spark, "corpus")
    d.select(F.col("text").alias("Context"), F.col("source").alias("Response")).write.parquet(corpus)
    return PS.load_training_pairs(spark, [lambda: PS.read_qa_pairs(spark, qa + "-missing"), lambda: PS.read_qa_pairs(spark, qa),
                                          lambda: PS.read_corpus_pairs(spark, corpus)])


@register("checked_pairs", """
WITH o AS (SELECT doc_id, text, CASE WHEN length(text) % 8 = 0 THEN 'malformed' WHEN length(text) % 8 = 1 THEN 'no question'
    WHEN text IS NULL THEN 'no answer' WHEN length(text) <= 100 THEN 'short answer' ELSE 'loaded' END AS outcome FROM documents)
SELECT doc_id, outcome, CASE WHEN outcome = 'loaded' THEN md5(text) END AS answer_md5 FROM o""")
def q_checked_pairs(spark, sf_dir):
    """What became of every record of faulty pair files: loaded, or in quarantine with a reason."""
    args = {"path": TD.faulty_pairs_folder(spark, sf_dir), "columns": ["id", "questionText", "answerText"],
            "question": "questionText", "answer": "answerText", "header": False}
    pairs, quarantine = PS.load_checked_pairs(spark, {"faulty": args})
    return pairs.select(F.substring("transcript", 2, 20).cast("long").alias("doc_id"), F.lit("loaded").alias("outcome"),
                        F.md5("reference_summary").alias("answer_md5")).unionByName(
        quarantine.select(F.regexp_extract("record", r'^(?:\{"id":")?([0-9]+)', 1).cast("long").alias("doc_id"),
                          F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("answer_md5")))


@register("results_sink", ORACLE["session_lengths"])
def q_results_sink(spark, sf_dir):
    """Two result tables written twice through the sink; the session lengths as the newest manifest gives them."""
    folder = TD.new_folder(spark, "results")
    tables = {"profile": q_profile(spark, sf_dir), "lengths": q_lengths(spark, sf_dir)}
    PS.write_results({"lengths": tables["lengths"].limit(0)}, folder)
    PS.write_results(tables, folder)
    return PS.read_results(spark, folder)["lengths"]
