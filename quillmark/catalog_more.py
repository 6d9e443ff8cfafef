"""Registered queries over conversations, reads, timelines, translations, corpora and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.catalog import documents, injected, query
from quillmark.operators import consensus, conversation, fix, metrics, mining, smpte, timeline, translation
from quillmark.plans import oracle
from quillmark.session import table

_LINES = f"WITH {oracle.VIEWS.strip()}\n"


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_sql, items)) + "]"


# ---- conversations, with a phrase added to each turn so that every rule has something to find

AGENT = ("Your appointment is booked for Sunday.", "I have processed your refill.", "Take 20 mg twice a day.", "Dr. Wolfe can see you.", "We have openings with him.", "Could you confirm your date of birth please?", "Connecting you to a representative now.", "Goodbye, have a great day.", "I have your date of birth as May 1.", "Your dob again please.", "We sent it to your pharmacy.", "You're all set for Monday.", "Please tell me your date of birth first.")
PATIENT = ("I need a refill.", "Please cancel it.", "I was born in 1980.", "Is Doctor Fake there?", "With Dr. Adams please.", "Hello.", "Thanks.")
CLOSED, DOCTORS, FAKES = ("sunday", "saturday"), ("adams", "baker"), ("fake",)


def _conversations(spark, sf_dir):
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), ((F.col("conv_id") * 5 + F.col("turn") * 3) % len(items)).cast("int") + 1)
    phrase = F.when(F.col("role") == "assistant", pick(AGENT)).when(F.col("role") == "user", pick(PATIENT)).otherwise("")
    return table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), phrase))


def _facts(spark):
    return (spark.createDataFrame([(d,) for d in CLOSED], "day string"), spark.createDataFrame([(d,) for d in DOCTORS], "name string"), spark.createDataFrame([(d,) for d in FAKES], "name string"))


_T = f"""WITH said AS (SELECT conv_id, turn, role = 'assistant' AS agent, coalesce(text, '') || ' ' || CASE role WHEN 'assistant' THEN ({_list(AGENT)})[CAST((conv_id * 5 + turn * 3) % {len(AGENT)} AS INT) + 1] WHEN 'user' THEN ({_list(PATIENT)})[CAST((conv_id * 5 + turn * 3) % {len(PATIENT)} AS INT) + 1] ELSE '' END AS text FROM conversations WHERE role IN ('assistant', 'user')),
t AS (SELECT *, lower(text) AS low FROM said)
"""


def _has(phrases) -> str:
    return "(" + " OR ".join(f"contains(low, {_sql(p)})" for p in phrases) + ")"


def _out(rows: str, rule: str, severity: str) -> str:
    return f"SELECT conv_id, turn, '{rule}' AS rule, '{severity}' AS severity, substr(text, 1, 160) AS evidence FROM ({rows})"


_FIRST = "SELECT * FROM ({}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1"
_RULES = {
    "closed_day": (lambda t, f: conversation.closed_day(t, f[0]), _out("SELECT t.*, unnest(list_filter(" + _list(CLOSED) + r", lambda d: list_contains(regexp_extract_all(low, '\w+'), d))) FROM t WHERE agent AND " + _has(conversation.BOOKED), "closed_day_booking", "critical")),
    "refill_without_verification": (lambda t, f: conversation.refill_without_verification(t), _out(_FIRST.format("SELECT * FROM t WHERE agent AND " + _has(conversation.PROCESSED) + " AND conv_id IN (SELECT conv_id FROM t WHERE agent AND " + _has(conversation.REFILL) + ") AND conv_id NOT IN (SELECT conv_id FROM t WHERE agent AND " + _has(conversation.IDENTITY) + ")"), "refill_without_verification", "critical")),
    "prescribes_dose": (lambda t, f: conversation.prescribes_dose(t), _out("SELECT * FROM t WHERE agent AND (" + " OR ".join(f"regexp_matches(low, {_sql(p)})" for p in conversation.DOSES) + ") AND NOT " + _has(conversation.REFUSALS), "medical_advice", "moderate")),
    "hallucinated_doctor": (lambda t, f: conversation.hallucinated_doctor(t, f[1]), _out(r"SELECT * FROM (SELECT t.*, lower(unnest(regexp_extract_all(text, '(?i)\b(?:dr\.?|doctor)\s+([A-Za-z]+)', 1))) AS name FROM t WHERE agent) a WHERE name NOT IN ('adams', 'baker') AND NOT EXISTS (SELECT 1 FROM t p WHERE NOT p.agent AND p.conv_id = a.conv_id AND p.turn < a.turn AND contains(p.low, a.name))", "hallucinated_doctor", "moderate")),
    "played_along_fake_provider": (lambda t, f: conversation.played_along_fake_provider(t, f[2]), _out(_FIRST.format("SELECT * FROM t WHERE agent AND " + _has((*conversation.BOOKED, "openings", "available")) + " AND NOT " + _has(conversation.CORRECTED) + r" AND conv_id IN (SELECT conv_id FROM t WHERE NOT agent AND regexp_matches(low, '\b(?:dr\.?|doctor)\s+fake(?:[^a-z]|$)'))"), "played_along_fake_provider", "critical")),
    "repetition_second": (lambda t, f: conversation.repetition(t), _out(r"SELECT * FROM (SELECT *, regexp_replace(trim(low), '\s+', ' ', 'g') AS key FROM t WHERE agent) WHERE length(key) >= 20 QUALIFY row_number() OVER (PARTITION BY conv_id, key ORDER BY turn) = 2", "repetition", "minor")),
    "dropped_intent": (lambda t, f: conversation.dropped_intent(t), _out("SELECT * FROM (" + "SELECT * FROM t WHERE agent QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) WHERE " + _has(conversation.LEAVES) + " AND conv_id IN (SELECT conv_id FROM t WHERE NOT agent AND " + _has(("cancel", "refill")) + ") AND conv_id NOT IN (SELECT conv_id FROM t WHERE agent AND (" + _has(conversation.HANDLED) + " OR " + _has(("connecting you", "transfer you to", "to a representative")) + "))", "dropped_intent", "moderate")),
    "fabricated_identity": (lambda t, f: conversation.fabricated_identity(t), _out(_FIRST.format(r"SELECT * FROM t WHERE agent AND (regexp_matches(low, 'date of birth as\s*\S') OR contains(low, 'profile has been created') OR contains(low, 'profile created')) AND conv_id NOT IN (SELECT conv_id FROM t WHERE NOT agent AND (regexp_matches(low, '" + conversation.MONTH + r"') OR contains(low, 'date of birth') OR contains(low, 'born') OR regexp_matches(low, '\b(19|20)\d\d\b')))"), "fabricated_identity", "critical")),
    "stuck_loop_rownum": (lambda t, f: conversation.stuck_loop(t), _out("SELECT * FROM (" + " UNION ALL ".join(f"SELECT *, '{k}' AS field FROM t WHERE agent AND {_has(v)}" for k, v in conversation.DEMANDS.items()) + ") QUALIFY row_number() OVER (PARTITION BY conv_id, field ORDER BY turn) = 3", "stuck_loop", "moderate")),
    "false_transfer_sequence": (lambda t, f: conversation.false_transfer(t), _out(_FIRST.format("SELECT t.* FROM t JOIN (SELECT conv_id, min(turn) AS since FROM t WHERE agent AND " + _has(conversation.TRANSFERS) + ") a USING (conv_id) WHERE agent AND turn > since AND NOT " + _has(conversation.TRANSFERS) + " AND (contains(low, 'goodbye') OR (contains(low, 'you''ve reached the') AND contains(low, 'test line')))").replace(") a USING", " GROUP BY conv_id) a USING"), "false_transfer", "moderate")),
}


def _conversation_query(f):
    return lambda spark, sf_dir: f(conversation.turns(_conversations(spark, sf_dir)), _facts(spark))


for _name, (_f, _q) in _RULES.items():
    query(f"agent_{_name}", _T + _q)(_conversation_query(_f))
query("agent_audit", _T + " UNION ALL ".join(q for _, q in _RULES.values()))(lambda spark, sf_dir: conversation.audit(_conversations(spark, sf_dir), *_facts(spark)))


# ---- reads of witnesses, made from the benchmark passages

def _passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("en").alias("lang"), "text")


def _reads(spark, sf_dir):
    return consensus.synthetic_reads(_passages(spark, sf_dir))


def _read_sql(every: int = 7) -> str:
    one = "SELECT doc_id AS clip_id, '{n}' AS witness, '{f}' AS family, lang, array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''), lambda x, i: CASE WHEN (i - 1 + doc_id + {s}) % {e} = 0 THEN substr(x, 1, 1) || 'q' ELSE x END), ' ') AS text FROM (SELECT item_id AS doc_id, 'en' AS lang, text FROM benchmark)"
    return "WITH reads AS (" + " UNION ALL ".join(one.format(n=n, f=consensus.FAMILIES[n], s=s, e=every + w) for w, (n, s) in enumerate((("scribe", 3), ("gemini", 5), ("whisper", 1), ("hf", 2)))) + r"""),
 clean AS (SELECT *, trim(regexp_replace(text, '[\(\[][^\)\]]{0,40}[\)\]]', ' ', 'g')) AS t FROM reads),
 norm AS (SELECT *, trim(regexp_replace(regexp_replace(lower(t), '[^\pL\pN_\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS norm FROM clean WHERE t <> '')
"""


query("family_agreement", _read_sql() + "SELECT clip_id, norm, count(DISTINCT family) AS families FROM norm GROUP BY clip_id, norm")(lambda s, d: consensus.family_agreement(_reads(s, d)))
query("family_majority", _read_sql() + "SELECT clip_id, max(n) AS majority FROM (SELECT clip_id, count(DISTINCT family) AS n FROM norm GROUP BY clip_id, norm) GROUP BY clip_id")(lambda s, d: consensus.majority(_reads(s, d)))
query("needs_slow", _read_sql() + "SELECT clip_id, max(n) < 2 AS needs_slow FROM (SELECT clip_id, count(DISTINCT family) AS n FROM norm GROUP BY clip_id, norm) GROUP BY clip_id")(lambda s, d: consensus.needs_slow(_reads(s, d)))
query("medoid_pick")(lambda s, d: consensus.medoid(_reads(s, d)))
query("consensus_vote")(lambda s, d: consensus.vote(_reads(s, d)))
query("vote_tokens_aligned")(lambda s, d: consensus.votes(_reads(s, d)))
query("consensus_tokens")(lambda s, d: consensus.consensus_tokens(_reads(s, d)))
query("agreement_pct")(lambda s, d: consensus.agreement_pct(_reads(s, d)))


@query("gate_status")
def gate_status(spark, sf_dir):
    reads = _reads(spark, sf_dir)
    clips = _passages(spark, sf_dir).select(F.col("doc_id").alias("clip_id"), "lang")
    health = clips.where("clip_id % 17 = 0").select("clip_id", "lang", F.lit("scribe").alias("witness"), F.lit("error").alias("status"))
    return consensus.gate(reads, consensus.consensus_tokens(reads, _lexicon(spark, sf_dir)), health).drop("reasons")


# ---- metrics

def _pairs(spark, sf_dir):
    """The scribe's read as the reference of each of the others, in ASCII."""
    reads = _reads(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    ref = reads.where("witness = 'scribe'").select("clip_id", F.col("text").alias("ref"))
    return reads.where("witness <> 'scribe'").join(ref, "clip_id").select("clip_id", "witness", "lang", "ref", F.col("text").alias("hyp"))


_PAIRS = _read_sql() + r""", ascii AS (SELECT clip_id, witness, lang, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS text FROM reads),
 pairs AS (SELECT h.clip_id, h.witness, h.lang, r.text AS ref, h.text AS hyp FROM ascii h JOIN ascii r ON h.clip_id = r.clip_id AND r.witness = 'scribe' WHERE h.witness <> 'scribe')
"""
query("cer_pairs", _PAIRS + r"""SELECT clip_id, witness, CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(r, h) / length(r), 4) END AS cer
 FROM (SELECT clip_id, witness, regexp_replace(lower(ref), '[^\w'']+|\s+', '', 'g') AS r, regexp_replace(lower(hyp), '[^\w'']+|\s+', '', 'g') AS h FROM pairs)""")(lambda s, d: metrics.cer(_pairs(s, d)).select("clip_id", "witness", "cer"))
_WER = _PAIRS + r""", tok AS (SELECT clip_id, witness, lang, regexp_extract_all(regexp_replace(lower(ref), '[^\w\s'']', ' ', 'g'), '\S+') AS r, regexp_extract_all(regexp_replace(lower(hyp), '[^\w\s'']', ' ', 'g'), '\S+') AS h FROM pairs),
 code AS (SELECT *, list_distinct(list_concat(r, h)) AS d FROM tok), enc AS (SELECT clip_id, witness, lang, array_to_string(list_transform(r, lambda x: chr(CAST(33 + list_position(d, x) AS INT))), '') AS r, array_to_string(list_transform(h, lambda x: chr(CAST(33 + list_position(d, x) AS INT))), '') AS h FROM code),
 e AS (SELECT clip_id, witness, lang, CASE WHEN length(r) = 0 THEN CASE WHEN length(h) = 0 THEN 0.0 ELSE 1.0 END ELSE round(levenshtein(r, h) / length(r), 4) END AS wer FROM enc)
"""
query("wer_pairs_encoded", _WER + "SELECT clip_id, witness, wer FROM e")(lambda s, d: metrics.wer(_pairs(s, d)).select("clip_id", "witness", "wer"))
_CHRF = " UNION ALL ".join(f"SELECT pair, '{side}' AS side, {n} AS n, substr({col}, unnest(range(1, length({col}) - {n} + 2)), {n}) AS g FROM w WHERE length({col}) >= {n}" for n in range(1, 7) for side, col in (("r", "ref"), ("h", "hyp")))
query("chrf_pairs", _PAIRS + f""", w AS (SELECT clip_id || ' ' || witness AS pair, trim(ref) AS ref, trim(hyp) AS hyp FROM pairs), g AS ({_CHRF}),
 c AS (SELECT pair, n, g, count(CASE WHEN side = 'r' THEN 1 END) AS r, count(CASE WHEN side = 'h' THEN 1 END) AS h FROM g GROUP BY ALL), o AS (SELECT pair, n, sum(least(r, h)) AS m, sum(r) AS r, sum(h) AS h FROM c GROUP BY ALL),
 m AS (SELECT pair, avg(CASE WHEN h > 0 THEN m / h END) AS p, avg(CASE WHEN r > 0 THEN m / r END) AS q FROM o GROUP BY pair)
 SELECT w.pair, coalesce(CASE WHEN p + q > 0 THEN round(5 * p * q / (4 * p + q), 3) ELSE 0.0 END, 0.0) AS chrf FROM w LEFT JOIN m USING (pair)""")(lambda s, d: metrics.chrf(_pairs(s, d).withColumn("pair", F.concat_ws(" ", "clip_id", "witness")), "pair"))
query("reliability_by_witness", _WER + "SELECT lang, witness, count(*) AS clips, round(1 - avg(wer), 4) AS reliability FROM e GROUP BY lang, witness HAVING count(*) >= 2")(lambda s, d: metrics.reliability(metrics.wer(_pairs(s, d))))
query("confusion_counts")(lambda s, d: mining.confusions(_pairs(s, d).select("lang", F.col("ref").alias("gold"), F.col("hyp").alias("heard"))))
query("confusion_inversion")(lambda s, d: mining.inverted(mining.confusions(_pairs(s, d).select("lang", F.col("ref").alias("gold"), F.col("hyp").alias("heard")))))


@query("injection_recall", f"SELECT 'no_exclamation' AS rule, count(*) AS cases, count(CASE WHEN regexp_matches(coalesce(text, '') || ({_list(oracle.SNIPPETS)})[CAST(doc_id % {len(oracle.SNIPPETS)} AS INT) + 1], '[!！]') THEN 1 END) AS caught FROM documents WHERE doc_id % {len(oracle.SNIPPETS)} = 2 HAVING count(*) > 0")
def injection_recall(spark, sf_dir):
    from quillmark.plans import packs, rules

    expected = documents(spark, sf_dir).where(F.col("doc_id") % len(oracle.SNIPPETS) == 2).select(F.col("doc_id").alias("case_id"), F.lit("no_exclamation").alias("rule"))
    return metrics.harness(expected, rules.flags(injected(spark, sf_dir), [packs.EXCLAMATION]).withColumnRenamed("doc_id", "case_id"))


# ---- timelines, made from the conversations' turns: a second of speech for ten characters

def _spoken(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length(F.coalesce("text", F.lit(""))) / 10.0
    end = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip_id"), F.col("turn").cast("int").alias("ord"), (end - size).alias("start"), (end - 0.3).alias("end"), F.col("role").alias("speaker"))


def _heard(spark, sf_dir):
    """Another diarizer: its own names, its turns 0.4 seconds late."""
    return _spoken(spark, sf_dir).select("clip_id", "ord", (F.col("start") + 0.4).alias("start"), (F.col("end") + 0.4).alias("end"), F.concat(F.lit("s"), F.length("speaker").cast("string")).alias("speaker"))


_SPOKEN = """WITH spoken AS (SELECT conv_id AS clip_id, turn AS ord, sum(length(coalesce(text, '')) / 10.0) OVER w - length(coalesce(text, '')) / 10.0 AS start, sum(length(coalesce(text, '')) / 10.0) OVER w - 0.3 AS "end", role AS speaker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
"""
query("speaker_map_overlap")(lambda s, d: timeline.map_ids(_spoken(s, d), _heard(s, d)))
query("diar_agreement_grid")(lambda s, d: timeline.agreement(_spoken(s, d), _heard(s, d)))
query("speaker_asof_midpoint")(lambda s, d: timeline.apply_reference_speakers(_heard(s, d), _spoken(s, d)).select("clip_id", "ord", "speaker"))
query("cross_consensus")(lambda s, d: timeline.cross_consensus(_spoken(s, d), {"other": _heard(s, d)}).select("clip_id", "ord", "speaker", "other", "agree"))
query("vad_coverage", _SPOKEN + """, s AS (SELECT clip_id, start + 0.4 AS s, "end" + 0.4 AS e FROM spoken WHERE "end" - start >= 0.8), u AS (SELECT clip_id, start AS us, "end" AS ue FROM spoken WHERE ord % 4 = 0),
 p AS (SELECT s.clip_id, s, e, sum(CASE WHEN us IS NULL THEN 0.0 ELSE least(e, ue) - greatest(s, us) END) AS ov FROM s LEFT JOIN u ON s.clip_id = u.clip_id AND us < e AND ue > s GROUP BY s.clip_id, s, e)
 SELECT clip_id, count(*) AS n_segments, count(CASE WHEN ov / (e - s) < 0.5 THEN 1 END) AS n_uncovered, round(100 * sum(least(ov, e - s)) / sum(e - s), 1) AS covered_pct FROM p GROUP BY clip_id""")(
    lambda s, d: timeline.verify_coverage(_heard(s, d), _spoken(s, d).where("ord % 4 = 0")))
query("seam_ownership", _SPOKEN + """SELECT clip_id, ord, round(start + (ord % 3) * 50.0, 3) AS start FROM spoken WHERE start < 50.0 AND (ord % 3 = 0 OR start >= 0.5)""")(
    lambda s, d: timeline.seam_owned(_spoken(s, d).withColumn("idx", F.col("ord") % 3).withColumn("offset", (F.col("ord") % 3) * 50.0), 50.0).select("clip_id", "ord", F.round("start", 3).alias("start")))
query("fixed_chunks", """WITH c AS (SELECT conv_id AS clip_id, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS duration FROM conversations GROUP BY conv_id)
 SELECT clip_id, CAST(unnest(range(0, greatest(1, CAST(ceil((duration - 5.0) / 95.0) AS BIGINT)))) AS INT) AS idx FROM c""")(
    lambda s, d: timeline.fixed_chunks(table(s, d, "conversations").groupBy(F.col("conv_id").alias("clip_id")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("duration")), 100.0, 5.0).select("clip_id", "idx"))
query("shot_bucket", "SELECT event_id % 50 AS clip_id, event_id AS frame, CAST(event_id // 240 AS INT) AS shot FROM events")(
    lambda s, d: timeline.shot_buckets(table(s, d, "events").select((F.col("event_id") % 50).alias("clip_id"), F.floor(F.col("event_id") / 240).cast("int").alias("shot")).distinct().select("clip_id", "shot", (F.col("shot") * 240).alias("f_in"), ((F.col("shot") + 1) * 240).alias("f_out")),
                                       table(s, d, "events").select((F.col("event_id") % 50).alias("clip_id"), F.col("event_id").alias("frame"))).select("clip_id", "frame", "shot"))
query("smpte_timecodes", """SELECT event_id, lpad(CAST(event_id // 24 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id // 24 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id // 24 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') AS tc, event_id AS frames FROM events""")(
    lambda s, d: table(s, d, "events").select("event_id", smpte.frame_to_tc(F.col("event_id"), F.lit(24)).alias("tc")).withColumn("frames", smpte.tc_to_frames(F.col("tc"), F.lit(24))))
query("smpte_drop_round_trip", "SELECT event_id, event_id * 37 AS frames FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", (smpte.tc_to_frames(smpte.frame_to_tc_drop(F.col("event_id") * 37), F.lit(30)) + F.floor(F.col("event_id") * 37 / smpte.DAY) * smpte.DAY).alias("frames")))


# ---- translations: a whole document against the next one, with placeholders and numbers mixed in

def _sides(spark, sf_dir):
    """(pair_id, src_lang, source_text) and (pair_id, tgt_lang, translation), to be joined."""
    line = F.coalesce("text", F.lit(""))
    mark = F.element_at(F.array(*map(F.lit, ("{name} 1,200", "%s 3.5", "[1] 47", "plain"))), (F.col("doc_id") % 4).cast("int") + 1)
    src = documents(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("src_lang"), F.concat(line, F.lit(" "), mark).alias("source_text"))
    mark2 = F.element_at(F.array(*map(F.lit, ("{name} 1200", "%s 3,5", "47", "plain"))), F.pmod(F.col("doc_id") - 1, F.lit(4)).cast("int") + 1)
    tgt = documents(spark, sf_dir).select((F.col("doc_id") - 1).alias("pair_id"), F.lit("en").alias("tgt_lang"), F.concat(line, F.lit(" "), mark2).alias("translation"))
    return src, tgt


def _translations(spark, sf_dir):
    src, tgt = _sides(spark, sf_dir)
    return src.join(tgt, "pair_id")


def _length_band(spark, sf_dir):
    """Texts are measured before they meet, so that only their lengths are shuffled."""
    src, tgt = _sides(spark, sf_dir)
    src = src.select("pair_id", "src_lang", translation.span(F.col("source_text")).alias("ns"))
    return translation.length_flags(src.join(tgt.select("pair_id", "tgt_lang", translation.span(F.col("translation")).alias("nt")), "pair_id")).select("pair_id", "evidence")


_TR = r"""WITH p AS (SELECT s.doc_id AS pair_id, s.lang AS src, coalesce(s.text, '') || ' ' || (['{name} 1,200', '%s 3.5', '[1] 47', 'plain'])[CAST(s.doc_id % 4 AS INT) + 1] AS s,
 coalesce(t.text, '') || ' ' || (['{name} 1200', '%s 3,5', '47', 'plain'])[CAST((t.doc_id - 1) % 4 AS INT) + 1] AS t FROM documents s JOIN documents t ON t.doc_id = s.doc_id + 1)
"""
_BAG = "SELECT pair_id, value, CASE WHEN sum(w) > 0 THEN 'missing' ELSE 'introduced' END AS side, CAST(abs(sum(w)) AS BIGINT) AS n FROM (SELECT pair_id, unnest({a}) AS value, 1 AS w FROM p UNION ALL SELECT pair_id, unnest({b}) AS value, -1 AS w FROM p) GROUP BY pair_id, value HAVING sum(w) <> 0"
_PH = r"regexp_extract_all({}, '\{{\{{?\s*[\w.$-]+\s*\}}?\}}|%\(\w+\)[sdf]|%(?:\d+\$)?[sdf]|\[\d+\]|</?[a-zA-Z][\w:-]*(?:\s[^<>]*?)?/?>')"
_NUM = r"list_transform(regexp_extract_all({}, '\d+(?:[.,]\d+)*'), lambda x: CAST(CASE WHEN regexp_full_match(x, '\d{{1,3}}(?:[.,]\d{{3}})+') THEN regexp_replace(x, '[.,]', '', 'g') ELSE replace(CASE WHEN regexp_matches(x, '[.,].*[.,]') THEN regexp_replace(regexp_extract(x, '^(.*)[.,]', 1), '[.,]', '', 'g') || regexp_extract(x, '[.,]\d+$') ELSE x END, ',', '.') END AS DOUBLE))"
query("placeholder_survival", _TR + _BAG.format(a=_PH.format("s"), b=_PH.format("t")))(
    lambda s, d: translation.bag_difference(_translations(s, d).select("pair_id", translation.placeholders(F.col("source_text")).alias("a"), translation.placeholders(F.col("translation")).alias("b")), "pair_id", "a", "b").withColumn("n", F.col("n").cast("long")))
query("digits_bag_diff", _TR + _BAG.format(a=_NUM.format("s"), b=_NUM.format("t")))(lambda s, d: translation.number_survival(_translations(s, d)).withColumn("n", F.col("n").cast("long")))
query("length_band", _TR + r"""SELECT pair_id, printf('%.2f', floor(round(length(regexp_replace(t, '\s', '', 'g')) / length(regexp_replace(s, '\s', '', 'g')), 3) * 100 + 0.5) / 100) AS evidence FROM p WHERE length(regexp_replace(s, '\s', '', 'g')) > 0
 AND (round(length(regexp_replace(t, '\s', '', 'g')) / length(regexp_replace(s, '\s', '', 'g')), 3) < 0.5 OR round(length(regexp_replace(t, '\s', '', 'g')) / length(regexp_replace(s, '\s', '', 'g')), 3) > 1.9)""")(
    _length_band)
query("passthrough_ratio", _TR + r""", w AS (SELECT pair_id, regexp_extract_all(lower(s), '[\pL\pN_]+') AS sw, regexp_extract_all(lower(t), '[\pL\pN_]+') AS tw FROM p WHERE src <> 'en')
 SELECT pair_id FROM w WHERE len(sw) > 0 AND len(list_filter(sw, lambda x: list_contains(tw, x))) / len(sw) >= 0.70""")(
    lambda s, d: translation.echoes(_translations(s, d)).select("pair_id"))
query("translation_qa")(lambda s, d: translation.run_qa(_translations(s, d), s.createDataFrame([("en", "en", "the", "die")], "src_lang string, tgt_lang string, term string, rendering string")))
query("translation_verdicts")(lambda s, d: translation.verdicts(_translations(s, d), translation.run_qa(_translations(s, d))))
query("glossary_miss", _TR + r"""SELECT pair_id FROM p WHERE src = 'en' AND regexp_matches(lower(s), '(?:^|[^\pL\pN_])the(?:$|[^\pL\pN_])') AND NOT regexp_matches(lower(t), '(?:^|[^\pL\pN_])and(?:$|[^\pL\pN_])')""")(
    lambda s, d: translation.glossary_misses(*_sides(s, d), s.createDataFrame([("en-US", "en", "the", "and")], "src_lang string, tgt_lang string, term string, rendering string")).select("pair_id"))


# ---- mining

_WORDS = r"SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\pL+') AS w FROM documents"
query("collocations_topk", f"""WITH t AS ({_WORDS}), c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY word), top AS (SELECT word, n FROM c ORDER BY n DESC, word LIMIT 400),
 stop AS (SELECT word FROM top WHERE n >= 0.002 * (SELECT sum(n) FROM c)), p AS (SELECT a, b, count(*) AS n FROM (SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM t WHERE len(w) > 1) GROUP BY a, b HAVING count(*) >= 2),
 f AS (SELECT * FROM p WHERE a NOT IN (SELECT word FROM stop) AND b NOT IN (SELECT word FROM stop)), s AS (SELECT word, mate, CAST(sum(n) AS BIGINT) AS n FROM (SELECT a AS word, b AS mate, n FROM f UNION ALL SELECT b, a, n FROM f) GROUP BY word, mate)
 SELECT word, mate, n, CAST(row_number() OVER (PARTITION BY word ORDER BY n DESC, mate) AS INT) AS rank FROM s WHERE word IN (SELECT word FROM c WHERE n >= 3) QUALIFY rank <= 30""")(lambda s, d: mining.collocations(documents(s, d)))


@query("collocation_decision")
def collocation_decision(spark, sf_dir):
    sets = spark.createDataFrame([(1, "thing"), (1, "think"), (2, "than"), (2, "then"), (2, "that")], "set_id int, word string")
    lines = injected(spark, sf_dir).select("doc_id", F.lit(1).alias("n"), "text")
    return mining.decisions(lines, sets, mining.collocations(documents(spark, sf_dir)))


_KEY = "regexp_replace(regexp_replace(w, '[^a-z]', '', 'g'), '[aeiou]', '', 'g')"
query("homophone_groups", f"WITH x AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '\\pL+')) AS w FROM benchmark) SELECT {_KEY} AS reading, list_sort(list(w)) AS words FROM x GROUP BY reading HAVING count(*) >= 2")(
    lambda s, d: mining.homophones(table(s, d, "benchmark").select(F.explode(mining.words(F.col("text"))).alias("word")).distinct(), F.regexp_replace(F.regexp_replace("word", "[^a-z]", ""), "[aeiou]", "")))
query("gazetteer_distinct", r"""WITH s AS (SELECT unnest([c_name, n_name]) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey), c AS (SELECT unnest([s] || regexp_split_to_array(s, '\s+')) AS surface FROM s)
 SELECT DISTINCT lower(trim(surface)) AS surface FROM c WHERE length(trim(surface)) >= 2""")(
    lambda s, d: mining.gazetteer(table(s, d, "customer").join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("canonical"), F.col("n_name").alias("ascii"), F.lit(None).cast("string").alias("alternates"))).where(F.col("surface").isNotNull()))
_LEX = r"SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '\pL+')) AS word FROM benchmark"


def _lexicon(s, d):
    return table(s, d, "benchmark").select(F.explode(mining.words(F.col("text"))).alias("word")).distinct()


query("oov_words_anti", _LINES + f", lex AS ({_LEX}), t AS (SELECT DISTINCT doc_id, n, unnest(regexp_extract_all(lower(raw), '\\pL+')) AS word FROM lines) SELECT doc_id, CAST(n AS INT) AS n, word FROM t WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM lex)")(
    lambda s, d: mining.unknown_words(injected(s, d), _lexicon(s, d)))
query("confusables_semi", _LINES + r""", sets AS (SELECT * FROM (VALUES (1, 'the'), (1, 'then'), (2, 'wrong'), (2, 'um')) AS v(set_id, word)), t AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, n, regexp_extract_all(lower(raw), '\pL+') AS w FROM lines))
 SELECT doc_id, CAST(n AS INT) AS n, set_id, word FROM t JOIN sets USING (word) QUALIFY row_number() OVER (PARTITION BY doc_id, n, set_id ORDER BY pos) = 1""")(
    lambda s, d: mining.confusables(injected(s, d), s.createDataFrame([(1, "the"), (1, "then"), (2, "wrong"), (2, "um")], "set_id int, word string")))
query("name_candidates")(lambda s, d: mining.name_candidates(_lexicon(s, d), s.createDataFrame([("theran",), ("ana",), ("ines",), ("oriol",)], "name string")))


# ---- corrections and the gate before delivery

query("legal_fixed_text")(lambda s, d: fix.fix(injected(s, d), "legal"))
query("default_fixed_text")(lambda s, d: fix.fix(injected(s, d), "default"))
query("clean_verbatim_finish")(lambda s, d: injected(s, d).select("doc_id", fix.finished(fix.normalised_sounds(F.col("text"))).alias("text")))
query("ship_blockers", _LINES + r""", raws AS (SELECT doc_id, unnest(p) AS raw, unnest(range(1, len(p) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM injected)), b AS (
 SELECT doc_id, line, 'draft_header' AS kind, trim(raw) AS evidence FROM raws WHERE starts_with(ltrim(raw), '# ') AND (contains(upper(raw), 'DRAFT') OR contains(upper(raw), 'VERIFY'))
 UNION ALL SELECT doc_id, line, 'unconfirmed_speaker', regexp_extract(ltrim(raw), '^(?:\*\*\?[^:*\n]{1,40}:\*\*|\?[^:*\n]{1,40}:)') FROM raws WHERE regexp_matches(ltrim(raw), '^(?:\*\*\?[^:*\n]{1,40}:\*\*|\?[^:*\n]{1,40}:)')
 UNION ALL SELECT doc_id, line, 'unverified_span', substr(raw, strpos(raw, '⚠')) FROM raws WHERE contains(raw, '⚠')
 UNION ALL SELECT r.doc_id, 1, 'unresolved_ear', trim(raw) FROM raws r WHERE r.doc_id % 50 = 0 AND line = 1)
 SELECT doc_id, CAST(line AS INT) AS line, kind, CASE WHEN length(evidence) > 70 THEN substr(evidence, 1, 69) || '…' ELSE evidence END AS evidence FROM b""")(
    lambda s, d: fix.blockers(injected(s, d), documents(s, d).where("doc_id % 50 = 0").select("doc_id", F.lit(1).alias("line"), F.lit("unresolved").alias("decision"))))


# ---- events: the streaming operators' results in batch form

query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n"))
query("events_sliding", "SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")(
    lambda s, d: table(s, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n"))
query("events_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '1 hour' THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")(
    lambda s, d: table(s, d, "events").groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n"))
query("health_latest", "SELECT user_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")(
    lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.col("m.event_type").alias("status"), F.col("m.event_id").alias("event_id")))
