"""The engine's operators as named queries over the driver's tables, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timing as tm
from ..operators import align, intervals, quality_control, recurrences, sequence
from ..operators.apply_decisions import plain_text
from ..sources.adapters import ORACLE_VIEWS, cues, golden, read, regions, words
from ..sources.kept import kept

HOUR = 3_600_000_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a (spark, sf_dir) function; ``sql`` may use the adapter views."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql if sql.lstrip().startswith("WITH RECURSIVE") else ORACLE_VIEWS + (sql if sql.lstrip().startswith(",") else "\n" + sql)
        return fn

    return put


def width():
    return tx.display_width(tx_plain())


def tx_plain():
    return plain_text(F.col("text"))


PLAIN = "array_to_string([trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''], ' ')"
WIDTH = tx.display_width_sql("p")
LINE = "(PARTITION BY ep ORDER BY pos)"
FLOOR = "floor(floor({x} / (1000.0::DOUBLE / 30) + 1e-9) * (1000.0::DOUBLE / 30))::BIGINT"
CEIL = "CASE WHEN " + FLOOR + " < {x} - 1e-9 THEN floor((floor({x} / (1000.0::DOUBLE / 30) + 1e-9) + 1) * (1000.0::DOUBLE / 30))::BIGINT ELSE " + FLOOR + " END"


def floor_sql(x: str) -> str:
    return FLOOR.replace("{x}", f"({x})")


def ceil_sql(x: str) -> str:
    return CEIL.replace("{x}", f"({x})")


CPS = f""", w AS (SELECT *, {WIDTH} AS w, end_ms - start_ms AS d FROM (SELECT *, {PLAIN} AS p FROM v_cues)),
speed AS (SELECT ep, cue_id, start_ms, d, CASE WHEN d > 0 THEN round(w / (d / 1000.0::DOUBLE), 3) ELSE 0.0 END AS cps FROM w),
speedy AS (SELECT ep, cue_id, start_ms, cps, CASE WHEN cps > 30 THEN 'impossible_cps_fast' WHEN d > 2000 AND cps < 2 THEN 'impossible_cps_slow' END AS kind FROM speed)
"""


@query(CPS + "SELECT ep, cue_id, cps, kind FROM speedy")
def cps_lint(spark, sf):
    return quality_control.cps_lint(cues(spark, sf), width())


LINT = f""", lint_in AS (SELECT *, lag(end_ms) OVER {LINE} AS pe, lag(speaker) OVER {LINE} AS ps FROM v_cues),
lint AS (
  SELECT ep, cue_id, start_ms, 'negative_duration' AS kind, 'error' AS severity FROM lint_in WHERE end_ms < start_ms
  UNION ALL SELECT ep, cue_id, start_ms, 'min_duration', 'warning' FROM lint_in WHERE end_ms - start_ms < 700
  UNION ALL SELECT ep, cue_id, start_ms, 'frame_grid', 'warning' FROM lint_in WHERE least(abs(start_ms - ({floor_sql("start_ms")})), abs(({ceil_sql("start_ms")}) - start_ms)) > 1 OR least(abs(end_ms - ({floor_sql("end_ms")})), abs(({ceil_sql("end_ms")}) - end_ms)) > 1
  UNION ALL SELECT ep, cue_id, start_ms, 'line_count', 'warning' FROM lint_in WHERE len(string_split(text, chr(10))) > 2
  UNION ALL SELECT ep, cue_id, start_ms, 'line_length', 'warning' FROM (SELECT *, unnest(string_split(text, chr(10))) AS p FROM lint_in) WHERE {WIDTH} > 400
  UNION ALL SELECT ep, cue_id, start_ms, 'overlap', 'warning' FROM lint_in WHERE start_ms < pe AND (ps IS NULL OR speaker IS NULL OR ps = speaker))
"""


def _flags(spark, sf):
    return quality_control.style_lint(cues(spark, sf), tx.display_width)


@query(LINT + "SELECT * FROM lint")
def style_lint(spark, sf):
    return _flags(spark, sf)


@query(LINT + "SELECT ep, count(*) AS total, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info, count(DISTINCT cue_id) AS cues FROM lint GROUP BY ep")
def qc_summary(spark, sf):
    return quality_control.qc_summary(_flags(spark, sf))


@query(LINT + "SELECT severity, kind, count(*) AS n FROM lint GROUP BY ROLLUP (severity, kind)")
def qc_rollup(spark, sf):
    return quality_control.qc_rollup(_flags(spark, sf))


@query(LINT + """, f AS (SELECT ep, CASE WHEN kind = 'overlap' THEN [cue_id, cue_id - 1] ELSE [cue_id] END AS cue_ids, CASE WHEN kind <> 'frame_grid' THEN start_ms END AS start_ms, kind, severity, row_number() OVER (PARTITION BY ep ORDER BY kind, cue_id) AS nth FROM lint),
p AS (SELECT f.ep, nth, min(c.start_ms) AS at_ FROM (SELECT ep, nth, unnest(cue_ids) AS cue_id FROM f) f JOIN v_cues c ON c.ep = f.ep AND c.cue_id = f.cue_id GROUP BY ALL)
SELECT f.ep, list_min(cue_ids) AS cue_id, f.start_ms, kind, severity, row_number() OVER (PARTITION BY f.ep ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, coalesce(f.start_ms, at_) NULLS LAST, list_min(cue_ids), f.nth) AS rank FROM f LEFT JOIN p ON p.ep = f.ep AND p.nth = f.nth""")
def flag_sort(spark, sf):
    f = _flags(spark, sf)
    f = f.withColumn("nth", F.row_number().over(sequence.by("kind", "cue_id"))).withColumn("cue_ids", F.when(F.col("kind") == "overlap", F.array("cue_id", F.col("cue_id") - 1)).otherwise(F.array("cue_id")))
    f = f.withColumn("start_ms", F.when(F.col("kind") != "frame_grid", F.col("start_ms"))).drop("cue_id")
    return sequence.flag_order(f, cues(spark, sf)).select("ep", F.array_min("cue_ids").alias("cue_id"), "start_ms", "kind", "severity", "rank")


@query(f"SELECT ep, cue_id, {floor_sql('start_ms + cue_id')} AS low, {ceil_sql('start_ms + cue_id')} AS high FROM v_cues")
def frame_snap(spark, sf):
    t = F.col("start_ms") + F.col("cue_id")
    return cues(spark, sf).select("ep", "cue_id", tm.snap_floor(t, 30.0).alias("low"), tm.snap_ceil(t, 30.0).alias("high"))


@query(f", b AS (SELECT *, coalesce(start_ms - lag(end_ms) OVER {LINE} > 1200, true)::INT AS fresh FROM v_cues) SELECT ep, cue_id, (sum(fresh) OVER {LINE} - 1)::BIGINT AS batch FROM b")
def scene_batches(spark, sf):
    return sequence.scene_batches(cues(spark, sf)).select("ep", "cue_id", "batch")


GIVEN = "(pos * 5) % 8 * 1000 + pos"


@query(f", g AS (SELECT *, {GIVEN} AS given FROM v_cues), o AS (SELECT ep, cue_id, row_number() OVER (PARTITION BY ep ORDER BY given) - 1 AS from_pos, row_number() OVER (PARTITION BY ep ORDER BY start_ms, given) - 1 AS to_pos FROM g) SELECT *, from_pos <> to_pos AS moved FROM o")
def chronological_order(spark, sf):
    return sequence.chronological(cues(spark, sf).withColumn("given", F.expr(GIVEN))).select("ep", "cue_id", "from_pos", "to_pos", "moved")


@query(f", o AS (SELECT ep, lag(cue_id) OVER {LINE} AS left_id, cue_id AS right_id, lag(end_ms) OVER {LINE} - start_ms AS overlap_ms FROM v_cues) SELECT * FROM o WHERE overlap_ms > 0")
def overlap_flags(spark, sf):
    return sequence.overlap_flags(cues(spark, sf))


@query(f", g AS (SELECT *, {GIVEN} AS given FROM v_cues), o AS (SELECT ep, lag(cue_id) OVER w AS left_id, cue_id AS right_id, lag(start_ms) OVER w > start_ms AS falls FROM g WINDOW w AS (PARTITION BY ep ORDER BY given)) SELECT ep, left_id, right_id FROM o WHERE falls")
def order_inversions(spark, sf):
    return sequence.order_inversions(cues(spark, sf).withColumn("given", F.expr(GIVEN)))


@query(""", m AS (SELECT *, text = 'click' AS m FROM v_words), f AS (SELECT *, coalesce(m <> lag(m) OVER (PARTITION BY ep ORDER BY word_idx), true)::INT AS fresh FROM m),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY ep ORDER BY word_idx) - 1 AS run FROM f)
SELECT ep, run::BIGINT AS run, count(*) AS n, min(start_us) AS start_us, max(end_us) AS end_us, round(avg(confidence), 4) AS score FROM r WHERE m GROUP BY ep, run HAVING count(*) >= 3""")
def match_runs(spark, sf):
    return sequence.match_runs(words(spark, sf), F.col("text") == "click")


@query(f""", f AS (SELECT *, coalesce(start_us - lag(end_us) OVER w > {6 * HOUR} OR speaker <> lag(speaker) OVER w, true)::INT AS fresh FROM v_words WINDOW w AS (PARTITION BY ep ORDER BY word_idx)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ep ORDER BY word_idx) - 1 AS grp FROM f) SELECT ep, grp::BIGINT AS grp, count(*) AS n, min(start_us) AS start_us, max(end_us) AS end_us FROM g GROUP BY ep, grp""")
def sessionize_gap(spark, sf):
    return sequence.sessionize(words(spark, sf), 6 * HOUR)


@query(", c AS (SELECT ep, speaker, count(*) AS n, min(word_idx) AS first FROM v_words GROUP BY ep, speaker) SELECT ep, speaker, n FROM c QUALIFY row_number() OVER (PARTITION BY ep ORDER BY n DESC, first) = 1")
def dominant_speaker(spark, sf):
    return sequence.dominant_speaker(words(spark, sf))


@query(f""", d AS (SELECT *, end_us - start_us AS lasts, word_idx // 12 AS cue_id FROM v_words),
f AS (SELECT *, coalesce(start_us - lag(end_us) OVER w > {5 * HOUR} OR lag(lasts) OVER w > {HOUR} OR lasts > {HOUR}, true)::INT AS fresh FROM d WINDOW w AS (PARTITION BY ep, cue_id ORDER BY start_us, word_idx)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ep, cue_id ORDER BY start_us, word_idx) - 1 AS part FROM f),
r AS (SELECT ep, cue_id, part::BIGINT AS part, count(*) FILTER (lasts <= {HOUR}) AS normal, count(*) AS n, min(start_us) AS start_us, max(end_us) AS end_us FROM g GROUP BY ALL)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ep, cue_id ORDER BY normal DESC, n DESC, end_us - start_us, part) = 1""")
def dense_cluster(spark, sf):
    return sequence.dense_cluster(words(spark, sf).withColumn("cue_id", F.floor(F.col("word_idx") / 12)), 5 * HOUR, HOUR)


@query(f""", t AS (SELECT *, pos % 3 <> 1 AS timed, CASE WHEN pos % 3 <> 1 THEN {{'s': start_ms + 700, 'e': end_ms + 700, 'ss': start_ms, 'se': end_ms}} END AS a0 FROM v_cues),
n AS (SELECT *, last_value(a0 IGNORE NULLS) OVER (PARTITION BY ep ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, first_value(a0 IGNORE NULLS) OVER (PARTITION BY ep ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q, greatest({ceil_sql("500")}, least(end_ms - start_ms, 2000)) AS d FROM t),
k AS (SELECT *, p IS NOT NULL AND q IS NOT NULL AS both_, least(q.s, {ceil_sql("q.s - greatest(0, q.ss - end_ms)")}) AS kept, p.e + least(1.0::DOUBLE, greatest(0.0::DOUBLE, (start_ms - p.se)::DOUBLE / greatest(1, q.ss - p.se))) * greatest(0, q.s - p.e) AS mid FROM n),
b AS (SELECT *, CASE WHEN kept >= d THEN kept ELSE q.s END AS bn FROM k),
u AS (SELECT *, CASE WHEN both_ THEN {floor_sql("mid")} WHEN p IS NOT NULL THEN {floor_sql("p.e + greatest(0, start_ms - p.se)")} WHEN q IS NOT NULL THEN greatest(0, {floor_sql("bn - d")}) END AS a FROM b),
v AS (SELECT *, CASE WHEN both_ THEN least(q.s, {ceil_sql("a + d")}) WHEN p IS NOT NULL THEN {ceil_sql("a + d")} WHEN q IS NOT NULL THEN bn END AS z FROM u),
w AS (SELECT *, CASE WHEN both_ AND z <= a THEN greatest(p.e, {floor_sql("q.s - d")}) ELSE a END AS a2 FROM v),
x AS (SELECT *, CASE WHEN both_ AND z <= a THEN greatest(q.s, {ceil_sql("a2 + 500")}) ELSE z END AS z2 FROM w)
SELECT ep, pos, cue_id, timed, CASE WHEN timed THEN start_ms + 700 ELSE coalesce(a2, start_ms) END AS new_start, CASE WHEN timed THEN end_ms + 700 ELSE coalesce(z2, end_ms) END AS new_end FROM x""")
def interpolate_unmatched(spark, sf):
    timed = F.col("pos") % 3 != 1
    late = lambda c: F.when(timed, F.col(c) + 700).otherwise(F.col(c))
    c = cues(spark, sf).withColumn("src_start_ms", F.col("start_ms")).withColumn("src_end_ms", F.col("end_ms"))
    return sequence.interpolate(c.withColumn("start_ms", late("start_ms")).withColumn("end_ms", late("end_ms")), timed).select("ep", "pos", "cue_id", "timed", "new_start", "new_end")


@query("SELECT ep, cue_id, lead(start_ms) OVER (PARTITION BY ep, coalesce(speaker, '__unknown__') ORDER BY pos) AS next_start FROM v_cues")
def next_same_speaker(spark, sf):
    return sequence.next_same_speaker(cues(spark, sf)).select("ep", "cue_id", "next_start")


@query(f""", x AS (SELECT *, lead(start_ms) OVER (PARTITION BY ep, coalesce(speaker, '__unknown__') ORDER BY pos) AS ns, {ceil_sql("start_ms + 1500")} AS least_end FROM v_cues)
SELECT ep, cue_id, CASE WHEN end_ms >= least_end THEN end_ms WHEN ns IS NULL OR end_ms > ns THEN least_end ELSE least(least_end, greatest(end_ms, ns)) END AS new_end FROM x""")
def extend_gap(spark, sf):
    return sequence.extend_into_gap(cues(spark, sf), 1500, 30.0).select("ep", "cue_id", "new_end")


@query(f""", x AS (SELECT *, lead(start_ms) OVER {LINE} AS ns FROM v_cues), y AS (SELECT *, CASE WHEN end_ms > ns THEN greatest(start_ms + 1, ns) ELSE end_ms END AS e FROM x)
SELECT ep, cue_id, CASE WHEN e > start_ms THEN {floor_sql('e')} ELSE e END AS new_end FROM y""")
def cap_overlaps(spark, sf):
    return sequence.cap_overlaps(cues(spark, sf), 30.0).select("ep", "cue_id", "new_end")


@query(f""", x AS (SELECT *, least({ceil_sql("start_ms + ceil(w / 90.0::DOUBLE * 1000)::BIGINT")}, greatest(start_ms + 1, {floor_sql("start_ms + 7000")})) AS need, coalesce(lead(start_ms) OVER {LINE}, 4611686018427387904) AS ns FROM (SELECT *, {WIDTH} AS w FROM (SELECT *, {PLAIN} AS p FROM v_cues)))
SELECT ep, cue_id, CASE WHEN need > end_ms AND ns >= need AND w > 0 THEN need ELSE end_ms END AS new_end FROM x""")
def cps_extend(spark, sf):
    return sequence.cps_extend(cues(spark, sf), width(), 90.0, 30.0).select("ep", "cue_id", "new_end")


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query(rf""", t AS (SELECT ep, pos, cue_id, {TOKENS} AS t FROM v_docs), p AS (SELECT *, lag(t) OVER {LINE} AS pt, [lag(cue_id, 2) OVER {LINE}, lag(cue_id) OVER {LINE}, cue_id] AS three FROM t),
k AS (SELECT ep, pos, [x FOR x IN three IF x IS NOT NULL] AS cue_ids, CASE WHEN t = pt[1:len(t)] THEN 'prefix' WHEN len(t) <= len(pt) AND t = pt[len(pt) - len(t) + 1:] THEN 'suffix' WHEN t[1:2] = pt[1:2] THEN 'opening' WHEN t[1:2] = pt[len(pt) - 1:] THEN 'ending' END AS kind FROM p WHERE len(t) >= 2 AND len(pt) >= 2)
SELECT ep, cue_ids[-1] AS cue_id, len(cue_ids)::INT AS n, arg_max(kind, pos) AS kind FROM k WHERE kind IS NOT NULL GROUP BY ep, cue_ids""".replace("v_docs", "(SELECT doc_id // 100 AS ep, doc_id AS pos, doc_id AS cue_id, text FROM documents)"))
def duplicate_fragment(spark, sf):
    d = read(spark, sf, "documents").select(F.expr("doc_id div 100").alias("ep"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("cue_id"), "text")
    found = sequence.duplicate_fragments(d.withColumn("toks", tx.tokens(F.col("text"))), F.col("toks"))
    return found.select("ep", F.element_at("cue_ids", -1).alias("cue_id"), F.size("cue_ids").alias("n"), "kind")


@query(rf", t AS (SELECT ep, pos, cue_id, len({TOKENS}) AS n_tokens FROM v_cues) SELECT ep, cue_id, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY ep ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM t".replace('\\"', '"'))
def token_offsets(spark, sf):
    return sequence.token_offsets(cues(spark, sf), tx.tokens(F.col("text"))).select("ep", "cue_id", "n_tokens", "offset")


@query("""SELECT ep, cue_id, CASE WHEN i < n % 3 * (n // 3 + 1) THEN i // (n // 3 + 1) ELSE n % 3 + (i - n % 3 * (n // 3 + 1)) // greatest(n // 3, 1) END AS part FROM (SELECT *, count(*) OVER (PARTITION BY ep) AS n, row_number() OVER (PARTITION BY ep ORDER BY pos) - 1 AS i FROM v_cues)""")
def even_parts(spark, sf):
    return sequence.even_parts(cues(spark, sf), F.lit(3)).select("ep", "cue_id", "part")


@query(rf""", t AS (SELECT ep, cue_id, start_ms, end_ms, {TOKENS} AS w FROM v_cues), u AS (SELECT *, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS i FROM t)
SELECT ep, cue_id, i AS token_idx, token, start_ms + (end_ms - start_ms) * (2 * i + 1)::DOUBLE / (2 * len(w)) AS expected_ms, greatest(2000, end_ms - start_ms) AS radius_ms FROM u""")
def time_priors(spark, sf):
    return sequence.time_priors(cues(spark, sf).withColumn("toks", tx.tokens(F.col("text"))), F.col("toks"))


@query("SELECT ep, cue_id, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) AS line, start_ms AS back FROM v_cues")
def srt_times(spark, sf):
    c = cues(spark, sf)
    return c.select("ep", "cue_id", F.concat(tm.srt_time(F.col("start_ms")), F.lit(" --> "), tm.srt_time(F.col("end_ms"))).alias("line"), tm.parse_srt_time(tm.srt_time(F.col("start_ms"))).alias("back"))


@query(r""", s AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY start_ms, end_ms, cue_id) AS n FROM v_cues),
b AS (SELECT ep, n, n || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || text AS block FROM s)
SELECT ep, count(*) AS cues, string_agg(block, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM b GROUP BY ep""")
def srt_render(spark, sf):
    from ..sources.srt import render

    return render(cues(spark, sf))


# ---- intervals


def _others(spark, sf):
    return words(spark, sf).where("text <> 'purchase'").select("ep", "word_idx", "start_us", "end_us", "speaker", "event_id")


COVER = """, c AS (SELECT * FROM v_words WHERE text <> 'purchase'), i AS (SELECT c.ep, c.word_idx, sum(least(c.end_us, r.end_us) - greatest(c.start_us, r.start_us))::BIGINT AS covered_us, max(r.end_us) AS last_us FROM c JOIN v_regions r ON c.ep = r.ep AND r.start_us < c.end_us AND c.start_us < r.end_us GROUP BY ALL)
"""


@query(COVER + "SELECT c.ep, c.word_idx, coalesce(covered_us, 0) AS covered_us FROM c LEFT JOIN i USING (ep, word_idx)")
def region_coverage(spark, sf):
    return intervals.region_coverage(_others(spark, sf), regions(spark, sf), "word_idx", 6 * HOUR).select("ep", "word_idx", "covered_us")


@query(COVER + "SELECT c.ep, c.word_idx, c.end_us - least(c.end_us, last_us) AS silence_us FROM c JOIN i USING (ep, word_idx) WHERE c.end_us - least(c.end_us, last_us) > 300000")
def trailing_silence(spark, sf):
    return intervals.trailing_silence(_others(spark, sf), regions(spark, sf), "word_idx", 6 * HOUR, 300_000).select("ep", "word_idx", "silence_us")


MERGE = """f AS (SELECT *, coalesce(start_us > max(end_us) OVER (PARTITION BY ep ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM src),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ep ORDER BY start_us, end_us, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS island FROM f) SELECT ep, island::BIGINT AS island, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM g GROUP BY ep, island"""


@query(", src AS (SELECT a.ep, greatest(a.start_us, b.start_us) AS start_us, least(a.end_us, b.end_us) AS end_us FROM v_words a JOIN v_words b ON a.ep = b.ep AND a.speaker < b.speaker AND b.start_us < a.end_us AND a.start_us < b.end_us), " + MERGE)
def turn_overlap_merge(spark, sf):
    return intervals.turn_overlaps(words(spark, sf), 6 * HOUR)


@query(", src AS (SELECT ep, start_us, end_us FROM v_words), " + MERGE)
def interval_union(spark, sf):
    return intervals.merge_intervals(words(spark, sf).select("ep", "start_us", "end_us"))


@query(""", p AS (SELECT *, (start_us + end_us) // 2 AS mid FROM v_words WHERE text <> 'purchase'),
j AS (SELECT p.ep, p.word_idx, min(CASE WHEN r.start_us <= mid AND mid <= r.end_us THEN {'s': r.start_us, 'e': r.end_us} END) AS a, min(CASE WHEN r.start_us < p.end_us AND p.start_us < r.end_us THEN {'s': r.start_us, 'e': r.end_us} END) AS b FROM p JOIN v_regions r ON p.ep = r.ep AND r.start_us <= p.end_us AND p.start_us <= r.end_us GROUP BY ALL)
SELECT p.ep, p.word_idx, coalesce(a, b).s AS region_start, coalesce(a, b).e AS region_end FROM p LEFT JOIN j USING (ep, word_idx)""")
def containing_region(spark, sf):
    p = _others(spark, sf).withColumn("mid", F.expr("(start_us + end_us) div 2"))
    return intervals.containing_region(p, regions(spark, sf), "mid", "word_idx", 6 * HOUR).select("ep", "word_idx", "region_start", "region_end")


@query(""", q AS (SELECT ep, event_id AS probe_id, start_us AS t FROM v_words WHERE text = 'click'), p AS (SELECT ep, event_id AS point_id, start_us AS t FROM v_words WHERE text = 'view'),
lo AS (SELECT q.ep, q.probe_id, max(p.t) AS t FROM q JOIN p ON q.ep = p.ep AND p.t <= q.t GROUP BY ALL), hi AS (SELECT q.ep, q.probe_id, min(p.t) AS t FROM q JOIN p ON q.ep = p.ep AND p.t >= q.t GROUP BY ALL)
SELECT q.ep, q.probe_id, CASE WHEN hi.t IS NULL OR q.t - lo.t <= hi.t - q.t THEN q.t - lo.t ELSE hi.t - q.t END AS distance FROM q LEFT JOIN lo USING (ep, probe_id) LEFT JOIN hi USING (ep, probe_id)""")
def nearest_prior(spark, sf):
    w = words(spark, sf)
    probes = w.where("text = 'click'").select("ep", F.col("event_id").alias("probe_id"), F.col("start_us").alias("t"))
    points = w.where("text = 'view'").select("ep", F.col("event_id").alias("point_id"), F.col("start_us").alias("t"))
    return intervals.nearest(probes, points).select("ep", "probe_id", "distance")


@query(f""", f AS (SELECT *, coalesce(start_us - max(end_us) OVER (PARTITION BY ep ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {HOUR}, true)::INT AS fresh FROM v_regions),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ep ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain FROM f),
w AS (SELECT * FROM v_words WHERE text <> 'purchase'),
h AS (SELECT w.ep, w.word_idx, arg_min(g.chain, (g.start_us, g.end_us)) AS chain FROM w JOIN g ON g.ep = w.ep AND g.start_us <= w.start_us AND w.start_us <= g.end_us GROUP BY ALL),
e AS (SELECT w.ep, w.word_idx, max(g.end_us) AS speech_end FROM h JOIN w ON w.ep = h.ep AND w.word_idx = h.word_idx JOIN g ON g.ep = h.ep AND g.chain = h.chain AND g.start_us <= w.end_us AND g.end_us >= w.start_us GROUP BY ALL),
x AS (SELECT w.*, speech_end, end_us - start_us > {8 * HOUR} AS too_long, coalesce(end_us - speech_end > {HOUR // 2}, false) AS over FROM w LEFT JOIN e ON e.ep = w.ep AND e.word_idx = w.word_idx)
SELECT ep, word_idx, greatest(start_us, least(end_us, CASE WHEN too_long THEN start_us + {8 * HOUR} ELSE end_us END, CASE WHEN over THEN speech_end ELSE end_us END)) AS new_end, too_long OR over AS clamped FROM x""")
def word_clamp(spark, sf):
    return intervals.speech_envelope(_others(spark, sf), regions(spark, sf), 6 * HOUR, HOUR, HOUR // 2, 8 * HOUR).select("ep", "word_idx", "new_end", "clamped")


# ---- sequence joins, fits


def _doc_tokens(spark, sf, lang_rank):
    d = read(spark, sf, "documents").select((F.col("doc_id") - F.col("doc_id") % 40).alias("ep"), "doc_id", "text")
    d = d.where(F.col("doc_id") % 40 < 20) if lang_rank else d.where(F.col("doc_id") % 40 >= 20)
    # an array has less than 2**31 tokens, so no text reaches into the next one's places
    return d.select("ep", "doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("i", "token")).select("ep", (F.col("doc_id") % 40 * 2**32 + F.col("i")).alias("idx"), "token")


@query(rf""", t AS (SELECT doc_id - doc_id % 40 AS ep, doc_id, doc_id % 40 < 20 AS l, {TOKENS} AS w FROM documents), u AS (SELECT ep, l, doc_id % 40 * 4294967296 + generate_subscripts(w, 1) - 1 AS idx, unnest(w) AS token FROM t),
a AS (SELECT ep, token, min(idx) AS left_idx FROM u WHERE l GROUP BY ALL HAVING count(*) = 1), b AS (SELECT ep, token, min(idx) AS right_idx FROM u WHERE NOT l GROUP BY ALL HAVING count(*) = 1),
j AS (SELECT ep, token, left_idx, right_idx FROM a JOIN b USING (ep, token)), o AS (SELECT *, coalesce(right_idx < lag(right_idx) OVER (PARTITION BY ep ORDER BY left_idx), false) AS falls FROM j)
SELECT ep, token, left_idx, right_idx FROM o QUALIFY NOT bool_or(falls) OVER (PARTITION BY ep)""")
def unique_exact_pairs(spark, sf):
    return align.exact_pairs(_doc_tokens(spark, sf, True), _doc_tokens(spark, sf, False))


#: Anchors whose audio runs four per cent slower than the cues, some far off; the fit as the rules have it.
ANCHORS = """, anchors AS (SELECT ep, word_idx, start_us / 1e6 AS x, start_us / 1e6 * 1.04 + 3 + (event_id % 11 - 5) / 10 + CASE WHEN event_id % 29 = 0 THEN 40 ELSE 0 END AS y FROM v_words),
sm AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n, row_number() OVER (PARTITION BY ep ORDER BY x, y) - 1 AS i FROM anchors),
sp AS (SELECT * FROM sm WHERE n <= 128 OR list_contains([round_even(k * (n - 1) / 127.0::DOUBLE, 0)::BIGINT FOR k IN range(128)], i)),
ends AS (SELECT ep, count(*) AS n, max(x) - min(x) AS dx, abs(arg_max(y, i) - arg_min(y, i)) AS dy, median(y - x) AS off1 FROM sm GROUP BY ep),
one AS (SELECT ep, n, dx, dy, off1, median(abs(x + off1 - y)) AS miss1 FROM sm JOIN ends USING (ep, n) GROUP BY ALL),
sl AS (SELECT a.ep, median((b.y - a.y) / (b.x - a.x)) AS rate FROM sp a JOIN sp b ON a.ep = b.ep AND a.i < b.i JOIN ends e ON e.ep = a.ep WHERE e.dx >= 5 AND b.x - a.x >= greatest(1, e.dx * 0.1) GROUP BY a.ep),
off2 AS (SELECT ep, rate, median(y - rate * x) AS off2 FROM sm JOIN sl USING (ep) WHERE rate BETWEEN 0.5 AND 2 GROUP BY ALL),
two AS (SELECT ep, rate, off2, median(abs(rate * x + off2 - y)) AS miss2 FROM sm JOIN off2 USING (ep) GROUP BY ALL),
fit AS (SELECT ep, CASE WHEN miss2 < miss1 THEN rate ELSE 1.0 END AS rate, CASE WHEN miss2 < miss1 THEN off2 ELSE off1 END AS off, n FROM one LEFT JOIN two USING (ep) WHERE least(miss1, coalesce(miss2, miss1)) <= greatest(2.0, dy * 0.05))
"""


def _anchors(spark, sf):
    x = F.col("start_us") / 1e6
    y = x * 1.04 + 3 + (F.col("event_id") % 11 - 5) / 10 + F.when(F.col("event_id") % 29 == 0, 40).otherwise(0)
    return words(spark, sf).select("ep", x.alias("x"), y.alias("y"), "word_idx")


@query(ANCHORS + "SELECT ep, round(rate, 4) AS rate, round(off, 3) AS off, n FROM fit")
def theil_sen_fit(spark, sf):
    return align.theil_sen(_anchors(spark, sf)).select("ep", F.round("rate", 4).alias("rate"), F.round("offset", 3).alias("off"), "n")


@query(ANCHORS + "SELECT a.ep, a.word_idx, round(abs(y - (rate * x + off)), 1) AS residual FROM anchors a JOIN fit USING (ep) WHERE abs(y - (rate * x + off)) > 12")
def align_outliers(spark, sf):
    a = _anchors(spark, sf)
    return align.outliers(a, align.theil_sen(a), F.lit(12.0)).select("ep", "word_idx", F.round("residual", 1).alias("residual"))


def _turns(spark, sf, odd):
    return cues(spark, sf).where(F.col("pos") % 2 == odd).select("ep", F.col("pos").alias("idx"), tx.tokens(F.col("text")).alias("tokens"))


@query()
def align_tokens(spark, sf):
    return align.align_tokens(_turns(spark, sf, 0), _turns(spark, sf, 1))


RUN = ("ep", "first_op", "n_ops", "left_from", "left_to", "right_from", "right_to", "case_id")


@query()
def divergence_spans(spark, sf):
    return align.aligned_divergences(_turns(spark, sf, 0), _turns(spark, sf, 1)).select(*RUN)


# Short sequences over all cells: the letters of a part's name and brand against those of its type and name. Hundredths: a gap -75, unlike letters -60, the same 200.
SCRIPT = """WITH RECURSIVE seq AS (SELECT p_partkey AS ep, string_split(p_name || ' ' || lower(p_brand), '') AS a, string_split(lower(p_type) || ' ' || p_name, '') AS b FROM part),
f AS (SELECT ep, 0 AS i, [-75 * j FOR j IN range(len(b) + 1)] AS c FROM seq
 UNION ALL SELECT s.ep, f.i + 1, [list_max([v[k + 1] - 75 * (j - k) FOR k IN range(j + 1)]) FOR j IN range(len(v))] FROM f JOIN seq s ON s.ep = f.ep AND f.i < len(s.a),
  LATERAL (SELECT [greatest(f.c[j + 1] - 75, CASE WHEN j > 0 THEN f.c[j] + CASE WHEN s.a[f.i + 1] = s.b[j] THEN 200 ELSE -60 END ELSE -1000000 END) FOR j IN range(len(s.b) + 1)] AS v) z),
w AS (SELECT ep, len(a) AS i, len(b) AS j, 0 AS n, '' AS kind FROM seq
 UNION ALL SELECT w.ep, w.i - (k <> 'insert')::INT, w.j - (k <> 'delete')::INT, w.n + 1, k FROM w JOIN f ON f.ep = w.ep AND f.i = w.i LEFT JOIN f g ON g.ep = w.ep AND g.i = w.i - 1,
  LATERAL (SELECT CASE WHEN w.i > 0 AND g.c[w.j + 1] - 75 = f.c[w.j + 1] THEN 'delete' WHEN w.j > 0 AND f.c[w.j] - 75 = f.c[w.j + 1] THEN 'insert' ELSE 'pair' END AS k) z WHERE w.i > 0 OR w.j > 0),
o AS (SELECT w.ep, max(n) OVER (PARTITION BY w.ep) - n AS op_pos, CASE WHEN kind <> 'pair' THEN kind WHEN a[i + 1] = b[j + 1] THEN 'match' ELSE 'replace' END AS kind, CASE WHEN kind <> 'insert' THEN i END AS left_idx, CASE WHEN kind <> 'delete' THEN j END AS right_idx FROM w JOIN seq s ON s.ep = w.ep WHERE n > 0)
"""


NAMED = {"left": "concat(p_name, ' ', lower(p_brand))", "right": "concat(lower(p_type), ' ', p_name)"}


def _spelt(spark, sf, side):
    """A part's letters in one piece."""
    return read(spark, sf, "part").select(F.col("p_partkey").alias("ep"), F.lit(0).cast("long").alias("idx"), F.split(F.expr(NAMED[side]), "").alias("tokens"))


def _letters(spark, sf, side):
    d = _spelt(spark, sf, side).select("ep", F.posexplode("tokens").alias("i", "token"))
    return d.select("ep", F.col("i").cast("long").alias("idx"), "token")


@query(SCRIPT + "SELECT ep, op_pos, kind, left_idx, right_idx, CASE WHEN kind = 'match' THEN 1.0 ELSE 0.0 END AS score, false AS limited FROM o")
def align_names(spark, sf):
    return align.align_tokens(_spelt(spark, sf, "left"), _spelt(spark, sf, "right"))


@query(SCRIPT + """, m AS (SELECT *, sum((kind = 'match')::INT) OVER (PARTITION BY ep ORDER BY op_pos) AS after FROM o),
d AS (SELECT ep, after, min(op_pos) AS first_op, count(*) AS n_ops, min(left_idx) AS left_from, max(left_idx) AS left_to, min(right_idx) AS right_from, max(right_idx) AS right_to FROM m WHERE kind <> 'match' GROUP BY ep, after)
SELECT ep, first_op, n_ops, left_from, left_to, right_from, right_to, 'case-' || row_number() OVER (PARTITION BY ep ORDER BY first_op) AS case_id FROM d""")
def name_divergences(spark, sf):
    return align.aligned_divergences(_spelt(spark, sf, "left"), _spelt(spark, sf, "right")).select(*RUN)


PARTS = SCRIPT + """, d AS (SELECT o.*, s.a[left_idx + 1] AS lt, left_idx // 4 AS lc, s.b[right_idx + 1] AS rt, right_idx * 1000 AS rs, right_idx * 1000 + 700 AS re, (right_idx % 8) / 8 AS rc, CASE WHEN right_idx % 3 <> 2 THEN right_idx % 3 END AS rp FROM o JOIN seq s ON s.ep = o.ep)
"""


def _part_words(spark, sf):
    w, i = _letters(spark, sf, "right"), F.col("idx")
    return w.select("ep", i.alias("word_idx"), F.col("token").alias("text"), (i * 1000).alias("start_us"), (i * 1000 + 700).alias("end_us"), (i % 8 / 8).alias("confidence"), F.when(i % 3 != 2, i % 3).alias("speaker"))


@query(PARTS + """, x AS (SELECT *, sum((kind = 'match')::INT) OVER w AS run, last_value(CASE WHEN kind = 'match' THEN {'c': lc, 'i': left_idx, 's': rs, 'e': re, 'p': rp} END IGNORE NULLS) OVER w AS p, first_value(CASE WHEN kind = 'match' THEN {'c': lc, 'i': left_idx, 's': rs, 'e': re, 'p': rp} END IGNORE NULLS) OVER (PARTITION BY ep ORDER BY op_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM d WINDOW w AS (PARTITION BY ep ORDER BY op_pos)),
g AS (SELECT ep, run, min(op_pos) AS first_op, min(lc) AS first_cue, count(DISTINCT lc) AS n_cues, coalesce(string_agg(lt, ' ' ORDER BY op_pos), '') AS srt_text, coalesce(string_agg(rt, ' ' ORDER BY op_pos), '') AS asr_text, count(left_idx) AS n_tokens, count(right_idx) AS n_words, coalesce(min(rc), 0.0) AS confidence, count(DISTINCT rp) AS n_speakers, min(rs) AS a, max(re) AS z, any_value(p) AS p, any_value(n) AS n FROM x WHERE kind <> 'match' GROUP BY ep, run),
h AS (SELECT *, n_words > 0 AND n_tokens = 0 AS ins FROM g)
SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY first_op) AS nth, first_cue, n_cues, srt_text, asr_text, n_tokens, n_words, confidence, n_speakers, coalesce(a, p.e, n.s) AS start_us, coalesce(z, n.s, p.e) AS end_us, CASE WHEN ins THEN p.c END AS left_cue, CASE WHEN ins THEN n.c END AS right_cue, CASE WHEN ins AND p.c = n.c THEN n.i - n.c * 4 END AS insert_at, CASE WHEN ins THEN p.e END AS left_end_us, CASE WHEN ins THEN n.s END AS right_start_us, CASE WHEN ins THEN p.p END AS left_speaker, CASE WHEN ins THEN n.p END AS right_speaker FROM h""")
def divergence_details(spark, sf):
    left = _letters(spark, sf, "left").withColumn("cue_id", F.floor(F.col("idx") / 4))
    d = align.divergence_details(align.align_tokens(_spelt(spark, sf, "left"), _spelt(spark, sf, "right")), left, _part_words(spark, sf))
    n = lambda c: F.size(c).cast("long")
    return d.select("ep", "nth", F.get("cue_ids", 0).alias("first_cue"), n("cue_ids").alias("n_cues"), "srt_text", "asr_text", n("token_idx").alias("n_tokens"), n("word_idx").alias("n_words"), "confidence", n("speaker_ids").alias("n_speakers"), "start_us", "end_us", "left_cue", "right_cue", "insert_at", "left_end_us", "right_start_us", "left_speaker", "right_speaker")


@query(PARTS + """, x AS (SELECT *, sum((kind <> 'match')::INT) OVER (PARTITION BY ep ORDER BY op_pos) AS run FROM d),
g AS (SELECT ep, run, min(op_pos) AS first_op, min(lc) AS first_cue, string_agg(lt, ' ' ORDER BY op_pos) AS srt_text, min(rs) AS start_us, max(re) AS end_us, count(*) AS n FROM x WHERE kind = 'match' GROUP BY ep, run)
SELECT ep, row_number() OVER (PARTITION BY ep ORDER BY first_op) AS nth, first_cue, srt_text, start_us, end_us, n, 1.0 AS score FROM g""")
def anchor_regions(spark, sf):
    left = _letters(spark, sf, "left").withColumn("cue_id", F.floor(F.col("idx") / 4))
    d = align.anchor_regions(align.align_tokens(_spelt(spark, sf, "left"), _spelt(spark, sf, "right")), left, _part_words(spark, sf), 1)
    return d.select("ep", "nth", F.get("cue_ids", 0).alias("first_cue"), "srt_text", "start_us", "end_us", "n", "score")


@query(ANCHORS + ", x AS (SELECT a.ep, word_idx // 10 AS cue_id, word_idx, round(abs(y - (rate * x + off)), 1) AS residual FROM anchors a JOIN fit USING (ep)) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY ep, cue_id ORDER BY residual DESC, word_idx) = 1")
def worst_outliers(spark, sf):
    a = _anchors(spark, sf)
    d = align.outliers(a, align.theil_sen(a), F.lit(-1.0)).select("ep", F.floor(F.col("word_idx") / 10).alias("cue_id"), "word_idx", F.round("residual", 1).alias("residual"))
    return align.worst_by_cue(d, "word_idx")


# ---- recurrences


@query(f"""WITH RECURSIVE {ORACLE_VIEWS.strip()[4:]}, o AS (SELECT *, row_number() OVER {LINE} AS k FROM v_cues),
r AS (SELECT ep, pos, cue_id, speaker, k, start_ms AS new_start, end_ms AS new_end FROM o WHERE k = 1
 UNION ALL SELECT o.ep, o.pos, o.cue_id, o.speaker, o.k, s.ns, CASE WHEN s.moved THEN greatest(o.end_ms, {ceil_sql("s.ns + 500")}) ELSE o.end_ms END
 FROM r JOIN o ON o.ep = r.ep AND o.k = r.k + 1, LATERAL (SELECT o.start_ms < r.new_end OR (o.start_ms = r.new_end AND o.speaker <> r.speaker) AS moved, CASE WHEN o.start_ms < r.new_end OR (o.start_ms = r.new_end AND o.speaker <> r.speaker) THEN CASE WHEN o.speaker = r.speaker OR o.speaker IS NULL OR r.speaker IS NULL THEN r.new_end ELSE {ceil_sql("r.new_end + 1")} END ELSE o.start_ms END AS ns) s)
SELECT ep, pos, cue_id, new_start, new_end FROM r""")
def residual_overlaps(spark, sf):
    return recurrences.residual_overlaps(cues(spark, sf))


@query(f"""WITH RECURSIVE {ORACLE_VIEWS.strip()[4:]}, o AS (SELECT *, row_number() OVER (PARTITION BY ep, speaker ORDER BY pos) AS k FROM v_cues),
r AS (SELECT ep, pos, cue_id, speaker, k, start_ms AS new_start, end_ms AS new_end FROM o WHERE k = 1
 UNION ALL SELECT o.ep, o.pos, o.cue_id, o.speaker, o.k, greatest(o.start_ms, r.new_end), CASE WHEN o.start_ms < r.new_end THEN greatest(o.end_ms, {ceil_sql("r.new_end + 500")}) ELSE o.end_ms END FROM r JOIN o ON o.ep = r.ep AND o.speaker = r.speaker AND o.k = r.k + 1)
SELECT ep, pos, cue_id, new_start, new_end FROM r""")
def enforce_monotonic(spark, sf):
    return recurrences.enforce_monotonic(cues(spark, sf))


@query()
def duplicate_merge(spark, sf):
    return recurrences.duplicate_merge(cues(spark, sf))


#: Which rows the one before takes in: a row that is itself taken in takes none.
TAKEN = """, o AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY pos) AS k FROM can),
r AS (SELECT ep, k, false AS taken FROM o WHERE k = 1 UNION ALL SELECT o.ep, o.k, NOT r.taken AND coalesce(o.fits, false) FROM r JOIN o ON o.ep = r.ep AND o.k = r.k + 1),
j AS (SELECT o.*, r.taken, coalesce(lead(r.taken) OVER (PARTITION BY o.ep ORDER BY o.k), false) AS takes, lead(end_ms) OVER (PARTITION BY o.ep ORDER BY o.k) AS next_end, lead(text) OVER (PARTITION BY o.ep ORDER BY o.k) AS next_text FROM o JOIN r ON r.ep = o.ep AND r.k = o.k)
"""


def _plain_sql(text: str) -> str:
    return PLAIN.replace("(text", f"({text}")


@query(f"""WITH RECURSIVE {ORACLE_VIEWS.strip()[4:]}, x AS (SELECT *, {WIDTH} AS w, end_ms - start_ms AS d FROM (SELECT *, {PLAIN} AS p FROM v_cues)),
y AS (SELECT *, lag(w) OVER {LINE} AS pw, lag(d) OVER {LINE} AS pd, lag(start_ms) OVER {LINE} AS ps, lag(end_ms) OVER {LINE} AS pe, lag(speaker) OVER {LINE} AS who FROM x),
can AS (SELECT ep, pos, cue_id, start_ms, end_ms, text, CASE WHEN pd > 0 THEN pw / (pd / 1000.0::DOUBLE) ELSE 0 END > 90 AND NOT coalesce(speaker <> who, false) AND greatest(w, pw) <= 400
  AND CASE WHEN greatest(pe, end_ms) > ps THEN (w + pw + CASE WHEN w > 0 AND pw > 0 THEN 1 ELSE 0 END) / ((greatest(pe, end_ms) - ps) / 1000.0::DOUBLE) ELSE 0 END <= 90 AS fits FROM y)
{TAKEN} SELECT ep, cue_id, CASE WHEN takes THEN 2 ELSE 1 END::BIGINT AS n, start_ms, CASE WHEN takes THEN greatest(end_ms, next_end) ELSE end_ms END AS end_ms, CASE WHEN takes THEN {_plain_sql("text")} || chr(10) || {_plain_sql("next_text")} ELSE text END AS text FROM j WHERE NOT taken""")
def cps_merge(spark, sf):
    return recurrences.cps_merge(cues(spark, sf), 90.0)


@query(f"""WITH RECURSIVE {ORACLE_VIEWS.strip()[4:]}, can AS (SELECT ep, pos, cue_id, start_ms, end_ms, text, speaker <> lag(speaker) OVER {LINE} AND start_ms < lag(end_ms) OVER {LINE} AS fits FROM v_cues)
{TAKEN} SELECT ep, cue_id, CASE WHEN takes THEN 2 ELSE 1 END::BIGINT AS n, start_ms, CASE WHEN takes THEN greatest(end_ms, next_end) ELSE end_ms END AS end_ms, CASE WHEN takes THEN '- ' || {_plain_sql("text")} || chr(10) || '- ' || {_plain_sql("next_text")} ELSE text END AS text FROM j WHERE NOT taken""")
def dash_merge(spark, sf):
    return recurrences.dash_merge(cues(spark, sf))


@query()
def words_to_cues(spark, sf):
    return recurrences.words_to_cues(words(spark, sf), 6 * HOUR, 48 * HOUR)


# ---- text


@query("""SELECT a.n_name AS a, b.n_name AS b, 200.0::DOUBLE * (length(a.n_name) + length(b.n_name) - d) / 2 / (length(a.n_name) + length(b.n_name)) AS ratio FROM (
  SELECT a.n_name AS x, b.n_name AS y, list_reduce(list_prepend([0 FOR j IN range(length(b.n_name) + 1)], [[unicode(c)] FOR c IN string_split(a.n_name, '')]), lambda row, c: list_prepend(0, [list_max([greatest(row[k + 1], row[k] + (unicode(substr(b.n_name, k, 1)) = c[1])::INT) FOR k IN range(1, j + 1)]) FOR j IN range(1, length(b.n_name) + 1)]))[-1] AS lcs
  FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey) z JOIN nation a ON a.n_name = x JOIN nation b ON b.n_name = y, LATERAL (SELECT length(a.n_name) + length(b.n_name) - 2 * lcs AS d) q""")
def indel_ratio(spark, sf):
    n = read(spark, sf, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("j"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("a", "b", tx.indel_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query(rf""", t AS (SELECT doc_id, {TOKENS} AS w FROM documents), g AS (SELECT doc_id, w, [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, greatest(len(w) - 2, 1) + 1)] AS tri FROM t)
SELECT doc_id, len(w) >= 12 AND len(list_distinct(w)) <= 0.35 * len(w) AND len(list_distinct(tri)) < len(tri) AS repetitive FROM g""")
def repetitive_text(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", tx.repetitive(F.col("w")).alias("repetitive"))


@query(r"""SELECT doc_id, array_to_string([regexp_replace(x, '^(.[^aeiouäöüAEIOUÄÖÜ]*)[aeiouäöüAEIOUÄÖÜ]', '\1*') FOR x IN regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')], ' ') AS masked FROM documents WHERE lang = 'de'""")
def censor_tokens(spark, sf):
    d = read(spark, sf, "documents").where("lang = 'de'")
    return d.select("doc_id", F.array_join(F.transform(tx.tokens(F.col("text")), tx.mask), " ").alias("masked"))


@query(rf""", d AS (SELECT doc_id, {TOKENS} AS w FROM documents), q AS (SELECT item_id, {TOKENS} AS w FROM benchmark WHERE length(text) > 60),
g AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i, w FROM d)
SELECT d.doc_id, q.item_id, min(g.i) - 1 AS first FROM q JOIN g ON g.a = q.w[1] AND len(g.w) >= g.i + len(q.w) - 1 AND g.w[g.i + 1] = q.w[2] AND g.w[g.i + 2] = q.w[3] AND g.w[g.i:g.i + len(q.w) - 1] = q.w JOIN d ON d.doc_id = g.doc_id GROUP BY d.doc_id, q.item_id""")
def subsequence_bounds(spark, sf):
    """The first run of as many tokens that reads like the item, else the first token that does.

    Both begin with the item's first signs, blanks left out, so the join is on these.
    """
    signs = 16
    q = read(spark, sf, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("q")).where(F.size("q") > 0)
    q = q.select("item_id", F.size("q").alias("k"), F.array_join("q", "").alias("joined")).withColumn("key", F.left("joined", F.lit(signs)))
    lengths = sorted(r[0] for r in q.select(F.length("key")).distinct().collect())  # at most ``signs`` numbers
    d = read(spark, sf, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"))
    at = d.select("doc_id", F.posexplode(F.transform("w", lambda x, i: F.left(F.array_join(F.slice("w", i + 1, signs), ""), F.lit(signs)))).alias("i", "start"))
    keys = F.array_distinct(F.array(*(F.left("start", F.lit(n)) for n in lengths or [signs])))
    near = at.select("doc_id", "i", F.explode(keys).alias("key")).join(q, "key").join(d, "doc_id")
    run = F.slice("w", F.col("i") + 1, F.col("k"))
    near = near.withColumn("run", (F.size(run) == F.col("k")) & (F.array_join(run, "") == F.col("joined"))).withColumn("one", F.get("w", F.col("i")) == F.col("joined"))
    first = F.coalesce(F.min(F.when(F.col("run"), F.col("i"))), F.min("i"))
    return near.where("run or one").groupBy("doc_id", "item_id").agg(first.cast("long").alias("first"))


# ---- evaluation, styles, costs


def _golden_part(spark, sf):
    """Golden cues, some of them left out, numbered anew: numbers say nothing of who belongs to whom."""
    g = golden(spark, sf).where("(pos * 7 + ep) % 11 <> 5")
    return g.withColumn("cue_id", F.row_number().over(sequence.by("pos")).cast("long"))


OVERLAPS = f", o AS (SELECT ep, unnest([lag(cue_id) OVER {LINE}, cue_id]) AS cue_id, unnest([lag(end_ms) OVER {LINE} > start_ms, lag(end_ms) OVER {LINE} > start_ms]) AS lies FROM v_cues), fl AS (SELECT ep, count(DISTINCT cue_id) AS n FROM o WHERE lies GROUP BY ep)"


@query(OVERLAPS + """, g AS (SELECT * FROM v_golden WHERE (pos * 7 + ep) % 11 <> 5), m AS (SELECT c.ep, abs(c.start_ms - g.start_ms) AS miss FROM v_cues c JOIN g ON g.ep = c.ep AND g.pos = c.pos),
t AS (SELECT ep, count(*) AS k, round(avg(miss), 3) AS mae, round(avg((miss <= 1000.0::DOUBLE / 30)::INT), 6) AS w1, round(avg((miss <= 3000.0::DOUBLE / 30)::INT), 6) AS w3 FROM m GROUP BY ep),
n AS (SELECT ep, count(*) AS p FROM v_cues GROUP BY ep), q AS (SELECT ep, count(*) AS q FROM g GROUP BY ep)
SELECT n.ep, p AS cue_count_predicted, coalesce(q, 0) AS cue_count_golden, coalesce(k, 0) AS matched_cues, mae AS start_mae_ms, w1 AS within_1, w3 AS within_3, 0::BIGINT AS style_violations, round(coalesce(fl.n, 0) / p, 6) AS review_burden,
coalesce(w1 >= 0.9 AND w3 >= 0.98 AND mae < 50, false) AS meets_timing, p = coalesce(q, 0) AS meets_structure, round(coalesce(fl.n, 0) / p, 6) <= 0.1 AS meets_review
FROM n LEFT JOIN q ON q.ep = n.ep LEFT JOIN t ON t.ep = n.ep LEFT JOIN fl ON fl.ep = n.ep""")
def evaluate_timing(spark, sf):
    from ..operators import evaluation

    c, g = cues(spark, sf), _golden_part(spark, sf)
    flags = sequence.overlap_flags(c).select("ep", F.array("left_id", "right_id").alias("cue_ids"))
    return evaluation.timing_metrics(c, g, evaluation.matched_cues(c, g), flags)


@query(""", n AS (SELECT ep, count(*) FILTER (cue_id % 10 = 0) AS tp, count(*) FILTER (cue_id % 7 = 0 AND cue_id % 10 <> 0) AS fp, count(*) FILTER (cue_id % 5 = 0 AND cue_id % 10 <> 0) AS fn FROM v_cues GROUP BY ep)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM n WHERE tp + fp + fn > 0""")
def improv_pr(spark, sf):
    from ..operators import evaluation

    c = cues(spark, sf)
    spoken = lambda when: c.withColumn("text", F.when(when, F.concat(F.lit("and then "), "text")).otherwise(F.col("text")))
    g, p = spoken(F.col("cue_id") % 5 == 0), spoken(F.col("cue_id") % 10 == 0)
    flags = c.where("cue_id % 10 = 0 or cue_id % 7 = 0").select("ep", F.lit("text_changed").alias("kind"), F.array("cue_id").alias("cue_ids"))
    return evaluation.improv_metrics(p, flags, evaluation.matched_cues(p, g), g, evaluation.matched_cues(c, g))


@query(""", t AS (SELECT ep, unnest([start_ms, end_ms]) AS t FROM v_cues), r(i, fps) AS (VALUES (0, 23.976::DOUBLE), (1, 24), (2, 25), (3, 29.97::DOUBLE), (4, 30)),
e AS (SELECT ep, i, fps, round(avg(abs(t - round_even(round_even(t / (1000.0::DOUBLE / fps), 0) * (1000.0::DOUBLE / fps), 0))), 6) AS error FROM t, r GROUP BY ALL),
n AS (SELECT *, row_number() OVER w AS rank, lead(error) OVER w AS nx FROM e WINDOW w AS (PARTITION BY ep ORDER BY error, i))
SELECT ep, fps, error AS error_ms, error <= 2 AND nx - error >= 0.25 AS confident FROM n WHERE rank = 1""")
def fps_detect(spark, sf):
    return quality_control.fps_detect(cues(spark, sf))


@query(f""", l AS (SELECT ep, pos, {WIDTH} AS w FROM (SELECT *, unnest(string_split(text, chr(10))) AS p FROM v_cues)), lr AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n, row_number() OVER (PARTITION BY ep ORDER BY w) AS i FROM l),
wide AS (SELECT ep, max(w) AS w FROM lr WHERE i <= CASE WHEN n < 20 THEN n ELSE greatest(1, ceil(0.95 * n)) END GROUP BY ep),
c AS (SELECT *, len(string_split(text, chr(10))) AS k, (end_ms - start_ms) / 1000.0::DOUBLE AS d, end_ms = lead(start_ms) OVER {LINE} AS z FROM v_cues),
o AS (SELECT *, count(*) OVER (PARTITION BY ep) AS n, row_number() OVER (PARTITION BY ep ORDER BY k) AS kr, row_number() OVER (PARTITION BY ep ORDER BY d) AS dr FROM c)
SELECT o.ep, count(*) AS n, greatest(2, max(k) FILTER (kr <= CASE WHEN n < 20 THEN n ELSE greatest(1, ceil(0.95 * n)) END)) AS max_lines, greatest(26, any_value(wide.w)) AS max_chars, least(round(min(d) FILTER (dr > CASE WHEN n < 20 THEN 0 ELSE floor(0.05 * n) END), 3), 0.5) AS min_dur, coalesce(bool_or(z), false) AS zero_gap, round(min(d), 3) AS shortest, round(max(d), 3) AS longest FROM o JOIN wide ON wide.ep = o.ep GROUP BY o.ep""")
def style_profile(spark, sf):
    return quality_control.style_profile(cues(spark, sf), tx.display_width)


@query(f""", l AS (SELECT ep, pos, max({WIDTH}) AS lw FROM (SELECT *, unnest(string_split(text, chr(10))) AS p FROM v_cues) GROUP BY ep, pos),
c AS (SELECT *, {WIDTH} AS w, len(string_split(text, chr(10))) AS k, (end_ms - start_ms) / 1000.0::DOUBLE AS d FROM (SELECT *, {PLAIN} AS p FROM v_cues))
SELECT c.ep, bool_and(d > 0 AND w > 0) AS usable, least(greatest(max(k), 1), 4)::BIGINT AS max_lines, least(greatest(max(lw), 10), 80)::BIGINT AS max_chars, round(least(greatest(min(d), 0.2), 5), 3) AS min_dur, round(least(greatest(max(d), 0.5), 20), 3) AS max_dur, round(least(greatest(min(w / d), 0), 10), 2) AS min_cps, round(least(greatest(max(w / d), 5), 60), 2) AS max_cps
FROM c JOIN l ON l.ep = c.ep AND l.pos = c.pos GROUP BY c.ep""")
def sample_style(spark, sf):
    return quality_control.sample_style(cues(spark, sf), tx.display_width)


@query(""", p(kind, i, o) AS (VALUES ('user', 1250, 5000), ('assistant', 2500, 10000)), t AS (SELECT ep, speaker AS kind, length(text) AS ti, length(text) * 2 AS t_o FROM v_cues)
SELECT ep, sum(ti)::BIGINT AS tokens_in, sum(t_o)::BIGINT AS tokens_out, sum((ti * coalesce(i, 0) + t_o * coalesce(o, 0) + 500) // 1000) / 1e6::DOUBLE AS usd FROM t LEFT JOIN p USING (kind) GROUP BY ep""")
def cost_totals(spark, sf):
    items = cues(spark, sf).select("ep", F.col("speaker").alias("kind"), F.length("text").cast("long").alias("tokens_in"), (2 * F.length("text")).cast("long").alias("tokens_out"))
    prices = spark.sql("SELECT * FROM VALUES ('user', 1250, 5000), ('assistant', 2500, 10000) AS t(kind, nano_in, nano_out)")
    return quality_control.cost_totals(items, prices)


# ---- media, edits, limits


def _numbered(spark, sf):
    return words(spark, sf).withColumn("n_tokens", F.col("event_id") % 3)


@query(""", c AS (SELECT ep, word_idx AS pos, word_idx AS cue_id, event_id % 3 AS n_tokens FROM v_words), o AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY ep ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM c)
SELECT o.ep, o.cue_id, min(w.start_us) AS start_us, max(w.end_us) AS end_us, round(avg(w.confidence), 4) AS score FROM o JOIN v_words w ON w.ep = o.ep AND w.word_idx >= f AND w.word_idx < f + n_tokens GROUP BY ALL""")
def forced_rollup(spark, sf):
    from ..operators import media

    c = _numbered(spark, sf).select("ep", F.col("word_idx").alias("pos"), F.col("word_idx").alias("cue_id"), "n_tokens")
    return media.forced_rollup(c, words(spark, sf).select("ep", "word_idx", "start_us", "end_us", "confidence"))


@query(""", s AS (SELECT ep, word_idx // 10 AS win, avg(((start_us // 1000) % 2001 - 1000)::DOUBLE * ((start_us // 1000) % 2001 - 1000)) AS ms FROM v_words GROUP BY ALL), l AS (SELECT * FROM s WHERE ms > 330000),
f AS (SELECT *, coalesce(win - lag(win) OVER (PARTITION BY ep ORDER BY win) > 1, true)::INT AS fresh FROM l), g AS (SELECT *, sum(fresh) OVER (PARTITION BY ep ORDER BY win) - 1 AS region FROM f)
SELECT ep, region::BIGINT AS region, min(win) AS first, max(win) AS last, count(*) AS n FROM g GROUP BY ep, region HAVING count(*) >= 2""")
def energy_vad(spark, sf):
    from ..operators import media

    samples = words(spark, sf).select("ep", F.col("word_idx").alias("sample_idx"), (F.floor(F.col("start_us") / 1000) % 2001 - 1000).alias("value"))
    return media.energy_regions(media.window_energy(samples, 10), F.col("mean_square") > 330000, 2)


@query(""", s AS (SELECT ep, cue_id AS case_id, pos AS first_pos, pos + 1 AS last_pos FROM v_cues WHERE cue_id % 3 = 0)
SELECT s.ep, s.case_id, CASE WHEN c.pos < first_pos THEN 'before' ELSE 'after' END AS side, c.pos, c.cue_id, c.text FROM s JOIN v_cues c ON c.ep = s.ep AND ((c.pos >= first_pos - 2 AND c.pos < first_pos) OR (c.pos > last_pos AND c.pos <= last_pos + 2))""")
def scene_context(spark, sf):
    from ..operators import edits

    c = cues(spark, sf)
    return edits.scene_context(c.where("cue_id % 3 = 0").select("ep", F.col("cue_id").alias("case_id"), F.col("pos").alias("first_pos"), (F.col("pos") + 1).alias("last_pos")), c)


@query("SELECT ep, cue_id, 'retimed' AS kind, '# retimed cue=' || cue_id || chr(10) || array_to_string(['- ' || x FOR x IN string_split(text, chr(10))], chr(10)) || chr(10) || '+ ' || speaker AS diff FROM v_cues WHERE text <> ''")
def changes_diff(spark, sf):
    from ..operators import edits

    return edits.changes_diff(cues(spark, sf).where("text <> ''").select("ep", "cue_id", F.lit("retimed").alias("kind"), F.col("text").alias("old_text"), F.col("speaker").alias("new_text")))


@query("SELECT ep, text, speaker, min(word_idx) AS word_idx FROM v_words GROUP BY ALL")
def dedupe_first(spark, sf):
    from ..operators import edits

    return edits.first_wins(words(spark, sf).select("ep", "text", "speaker", "word_idx"), ["word_idx"])


@query(r"""SELECT doc_id, sha256('{"lang":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"n_chars":' || n_chars || ',"source":' || coalesce(to_json(source)::VARCHAR, 'null') || '}') AS digest FROM documents""")
def cache_keys(spark, sf):
    from ..operators import edits

    d = read(spark, sf, "documents").withColumn("api_key", F.col("doc_id"))
    return edits.cache_keys(d, "source", "lang", "n_chars", "api_key").select("doc_id", "digest")


@query(f""", j AS (SELECT ep AS job_id, arg_max(CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'complete' ELSE 'failed' END, (start_us, event_id)) AS status, max(start_us) AS updated_us FROM v_words GROUP BY ep)
SELECT *, CASE WHEN status IN ('complete', 'failed') AND updated_us + {24 * HOUR} <= {720 * HOUR} THEN 'delete' WHEN status NOT IN ('complete', 'failed') AND updated_us <= {720 * HOUR} - {12 * HOUR} THEN 'fail' ELSE 'keep' END AS action FROM j""")
def job_expiry(spark, sf):
    from ..streaming import limits

    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "complete", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    e = words(spark, sf).select(F.col("ep").alias("job_id"), status.alias("status"), F.col("start_us").alias("ts_us"), "event_id")
    return limits.expire(limits.latest_state(e), 720 * HOUR, 24 * HOUR, 12 * HOUR)


@query(f"""WITH RECURSIVE {ORACLE_VIEWS.strip()[4:]}, o AS (SELECT ep AS key, event_id, start_us AS ts_us, row_number() OVER (PARTITION BY ep ORDER BY start_us, event_id) AS k FROM v_words),
r AS (SELECT key, event_id, ts_us, k, true AS allowed, [ts_us] AS held FROM o WHERE k = 1
 UNION ALL SELECT o.key, o.event_id, o.ts_us, o.k, len(s.open) < 3, CASE WHEN len(s.open) < 3 THEN list_append(s.open, o.ts_us) ELSE s.open END FROM r JOIN o ON o.key = r.key AND o.k = r.k + 1, LATERAL (SELECT [x FOR x IN r.held IF x >= o.ts_us - {24 * HOUR}] AS open) s)
SELECT key, event_id, ts_us, allowed FROM r""")
def rate_limit(spark, sf):
    from ..streaming import limits

    return limits.rate_limit(words(spark, sf).select(F.col("ep").alias("key"), "event_id", F.col("start_us").alias("ts_us")), 3, 24 * HOUR)


@query()
def name_drift(spark, sf):
    from ..operators import edits

    one = lambda t: read(spark, sf, t).select(F.explode(tx.tokens(F.col("text"))).alias("token"))
    return edits.name_drift(one("benchmark"), one("documents"))


# ---- predicates, placements, removals


@query(", w AS (SELECT *, start_us >= 0 AND end_us >= start_us AND coalesce(start_us >= lag(start_us) OVER (PARTITION BY ep ORDER BY word_idx), true) AS g FROM v_words) SELECT ep, bool_and(g) AS usable FROM w GROUP BY ep")
def ordered_intervals(spark, sf):
    from ..operators import decisions

    return decisions.ordered_intervals(words(spark, sf))


@query(f""", w AS (SELECT *, greatest(0, start_us - {HOUR}) AS lo, end_us + {HOUR} AS hi FROM v_words), s AS (SELECT *, CASE WHEN hi - lo > {4 * HOUR} THEN greatest(0, (lo + hi) // 2 - {2 * HOUR}) ELSE lo END AS snip_start FROM w)
SELECT ep, word_idx, snip_start, CASE WHEN hi - lo > {4 * HOUR} THEN snip_start + {4 * HOUR} ELSE hi END AS snip_end FROM s""")
def snippet_windows(spark, sf):
    from ..operators import decisions

    return decisions.snippet_windows(words(spark, sf), HOUR, 4 * HOUR).select("ep", "word_idx", "snip_start", "snip_end")


@query("SELECT w.ep, w.word_idx, min(r.start_us) AS first_start, arg_max(r.end_us, (r.start_us, r.end_us)) AS last_end FROM v_words w JOIN v_regions r ON w.ep = r.ep AND r.start_us < w.end_us AND w.start_us < r.end_us WHERE w.text <> 'purchase' GROUP BY ALL")
def region_ends(spark, sf):
    from ..operators import decisions

    return decisions.region_ends(_others(spark, sf), regions(spark, sf), "word_idx", 6 * HOUR)


@query("SELECT c.ep, c.region_idx AS cue_id, w.word_idx FROM v_regions c JOIN v_words w ON c.ep = w.ep AND w.end_us >= c.start_us AND w.start_us <= c.end_us WHERE w.text = 'click'")
def cue_words(spark, sf):
    from ..operators import decisions

    return decisions.cue_words(regions(spark, sf).withColumnRenamed("region_idx", "cue_id"), words(spark, sf).where("text = 'click'"), 6 * HOUR)


@query(rf""", t AS (SELECT ep, pos % 2 AS side, unnest({TOKENS}) AS token FROM v_cues), l AS (SELECT ep, token, count(*) AS n_left FROM t WHERE side = 0 GROUP BY ALL), r AS (SELECT ep, token, count(*) AS n_right FROM t WHERE side = 1 GROUP BY ALL)
SELECT ep, token, n_left, n_right FROM l JOIN r USING (ep, token) WHERE n_left > 1 OR n_right > 1""")
def repeated_tokens(spark, sf):
    from ..operators import decisions

    return decisions.repeated_tokens(_turns(spark, sf, 0), _turns(spark, sf, 1))


@query("SELECT ep, min(start_us) AS first_us, max(end_us) AS last_us, least(12000000, (max(end_us) - min(start_us)) // 10) AS limit_us FROM v_words GROUP BY ep")
def episode_extent(spark, sf):
    from ..operators import decisions

    return decisions.extent(words(spark, sf))


@query(f""", f AS (SELECT *, CASE WHEN cue_id % 2 = 0 THEN greatest(0, {floor_sql("start_ms + 40")}) END AS s FROM v_cues)
SELECT ep, cue_id, coalesce(s, start_ms) AS new_start, CASE WHEN s IS NULL THEN end_ms ELSE greatest({ceil_sql("end_ms - 200")}, {ceil_sql("s + 500")}) END AS new_end FROM f""")
def forced_apply(spark, sf):
    from ..operators import decisions

    c = cues(spark, sf)
    f = c.where("cue_id % 2 = 0").select("ep", "cue_id", (F.col("start_ms") + 40).alias("f_start"), (F.col("end_ms") - 200).alias("f_end"), F.lit(0).alias("seq"))
    return decisions.apply_forced(c, f, 30.0, 500).select("ep", "cue_id", "new_start", "new_end")


@query(""", b AS (SELECT * FROM v_cues WHERE cue_id % 3 <> 0), m AS (SELECT *, max(start_ms) OVER (PARTITION BY ep ORDER BY pos) AS reach FROM b),
u AS (SELECT ep, reach AS t, 1 AS side, pos, cue_id FROM m UNION ALL SELECT ep, start_ms + 7, 0, NULL, cue_id FROM v_cues WHERE cue_id % 3 = 0)
SELECT ep, cue_id, row_number() OVER (PARTITION BY ep ORDER BY t, side DESC, pos NULLS LAST, cue_id) - 1 AS place FROM u""")
def positional_merge(spark, sf):
    from ..operators import decisions

    c = cues(spark, sf)
    return decisions.positional_merge(c.where("cue_id % 3 <> 0"), c.where("cue_id % 3 = 0").withColumn("start_ms", F.col("start_ms") + 7))


@query("SELECT ep, cue_id FROM v_cues WHERE NOT (cue_id % 2 = 0 AND length(text) % 3 = 0)")
def silent_removal(spark, sf):
    from ..operators import decisions

    c = cues(spark, sf)
    return decisions.silent_removal(c, c.where("cue_id % 2 = 0"), c.where("length(text) % 3 = 0")).select("ep", "cue_id")


@query(ANCHORS + "SELECT ep, i, x FROM sp")
def sampled_anchors(spark, sf):
    return align.sampled(_anchors(spark, sf)).select("ep", F.col("i").cast("long").alias("i"), "x")


@query(LINT + "SELECT ep, cue_id, kind FROM lint")
def stale_flags(spark, sf):
    from ..operators import decisions, refinement

    fast = quality_control.cps_lint(cues(spark, sf), width(), most=15.0).where("kind is not null")
    return decisions.without_stale(refinement.union_flags(_flags(spark, sf), fast)).select("ep", "cue_id", "kind")


@query(""", e AS (SELECT user_id AS owner, event_id, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'complete' ELSE 'failed' END AS status FROM events)
SELECT owner, count(*) FILTER (status IN ('queued', 'processing')) AS busy, count(*) FILTER (status IN ('queued', 'processing')) + 1 <= 30 AS admitted FROM e GROUP BY owner""")
def job_admission(spark, sf):
    from ..operators import decisions

    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "complete", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return decisions.admission(read(spark, sf, "events").select(F.col("user_id").alias("owner"), status.alias("status")), 30)


@query(""", a AS (SELECT ep, cue_id, start_ms AS start_us, end_ms AS end_us FROM v_cues WHERE cue_id % 3 = 0), t AS (SELECT ep, max(cue_id) AS top FROM v_cues GROUP BY ep)
SELECT a.ep, a.cue_id AS seq, coalesce(top, 0) + row_number() OVER (PARTITION BY a.ep ORDER BY start_us, end_us, a.cue_id) AS cue_id FROM a LEFT JOIN t USING (ep)""")
def fresh_ids(spark, sf):
    from ..operators import decisions

    c = cues(spark, sf)
    added = c.where("cue_id % 3 = 0").select("ep", F.col("cue_id").alias("seq"), F.col("start_ms").alias("start_us"), F.col("end_ms").alias("end_us"))
    return decisions.fresh_ids(c, added).select("ep", "seq", "cue_id")


# ---- whole runs


def _spoken(spark, sf):
    """Words as they would be heard: the cues' tokens in their order, every seventh missing, half a second late."""
    from . import flows

    t = flows.cue_tokens(cues(spark, sf)).join(sequence.dealt(cues(spark, sf).select("ep", "cue_id", "start_ms", "end_ms", "speaker")), ["ep", "cue_id"])
    n, i = F.count("*").over(sequence.Window.partitionBy("ep", "cue_id")), F.row_number().over(sequence.Window.partitionBy("ep", "cue_id").orderBy("idx")) - 1
    at = F.col("start_ms") * 1000 + 500_000 + F.floor((F.col("end_ms") - F.col("start_ms")) * 1000 * i / n)
    d = t.withColumn("start_us", at.cast("long")).where("idx % 7 <> 3")
    place = F.row_number().over(sequence.Window.partitionBy("ep").orderBy("idx")) - 1
    return d.select("ep", place.cast("long").alias("word_idx"), F.col("token").alias("text"), "start_us", (F.col("start_us") + 40_000).alias("end_us"), F.lit(1.0).alias("confidence"), F.lit(None).cast("long").alias("speaker"))


@query()
def sync_episodes(spark, sf):
    from . import flows

    return flows.sync(cues(spark, sf), _spoken(spark, sf))


@query()
def generate_episodes(spark, sf):
    from . import flows

    return flows.generate(_spoken(spark, sf))


RECOGNISED = r""", hw AS (SELECT ep, pos, cue_id, start_ms, end_ms, unnest(w) AS text, generate_subscripts(w, 1) AS i FROM (SELECT *, regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM v_cues)), heard AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY pos, i) - 1 AS word_idx FROM hw)
"""


def _recognised(spark, sf):
    """Words as a recogniser has them: what blanks part, with signs and capitals."""
    order = sequence.Window.partitionBy("ep").orderBy("pos", "i")
    w = cues(spark, sf).select("ep", "pos", "cue_id", "start_ms", F.posexplode(F.regexp_extract_all("text", F.lit(r"([^ \t\r\n]+)"), 1)).alias("i", "text"))
    at = (F.col("start_ms") * 1000 + F.col("i") * 1000).cast("long")
    return w.select("ep", (F.row_number().over(order) - 1).cast("long").alias("word_idx"), "text", at.alias("start_us"), (at + 900).alias("end_us"), F.lit(None).cast("long").alias("speaker"))


@query(RECOGNISED + r"SELECT ep, cue_id, word_idx FROM heard WHERE regexp_matches(text, '[\p{L}\p{N}_]')")
def matched_whole(spark, sf):
    """J1/J15 where the words are split otherwise than the cues: every word that holds a letter finds its cue."""
    from . import flows

    return flows.matched_words(cues(spark, sf), _recognised(spark, sf)).select("ep", "cue_id", "word_idx")


def _lines(spark, sf):
    """Each line of a turn as a cue of its own, and some of them heard twice."""
    c = cues(spark, sf)
    d = c.select("ep", "pos", "start_ms", "end_ms", "speaker", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    at = lambda k: (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("n"))).cast("long")
    d = d.select("ep", (F.col("pos") * 2000 + F.col("i") * 2).alias("pos"), at(F.col("i")).alias("start_ms"), at(F.col("i") + 1).alias("end_ms"), "text", "speaker")
    again = d.where("pos % 7 = 2").select("ep", (F.col("pos") + 1).alias("pos"), (F.col("start_ms") + 30).alias("start_ms"), (F.col("end_ms") + 30).alias("end_ms"), F.upper("text").alias("text"), "speaker")
    return d.union(again).select("ep", "pos", (F.col("pos") + 1).alias("cue_id"), "start_ms", "end_ms", "text", "speaker")


@query()
def finalize_lines(spark, sf):
    """Lines as cues go out, and what was found."""
    from ..operators.finalize import Finish, finalize

    return finalize(_lines(spark, sf), Finish(chars=120, most_cps=100.0, longest_ms=4000))


SORTED = f"""WITH RECURSIVE {ORACLE_VIEWS.strip()[4:]}, o AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY start_ms, end_ms, cue_id) AS k FROM v_cues),
r AS (SELECT ep, cue_id, speaker, k, start_ms, end_ms, start_ms AS was_start, end_ms AS was_end, NULL::BIGINT AS before, NULL::VARCHAR AS kind FROM o WHERE k = 1
 UNION ALL SELECT o.ep, o.cue_id, o.speaker, o.k, s.ns, CASE WHEN s.kind IS NULL THEN o.end_ms ELSE greatest(o.end_ms, {ceil_sql("s.ns + 500")}) END, o.start_ms, o.end_ms, r.cue_id, s.kind
 FROM r JOIN o ON o.ep = r.ep AND o.k = r.k + 1, LATERAL (SELECT CASE WHEN o.start_ms < r.end_ms THEN 'output_overlap_resolved' WHEN o.start_ms = r.end_ms AND o.speaker <> r.speaker THEN 'speaker_transition_gap_inserted' END AS kind,
   CASE WHEN o.start_ms < r.end_ms OR (o.start_ms = r.end_ms AND o.speaker <> r.speaker) THEN CASE WHEN o.speaker <> r.speaker THEN {ceil_sql("r.end_ms + 1")} ELSE r.end_ms END ELSE o.start_ms END AS ns) s),
inv AS (SELECT ep, cue_id, start_ms, end_ms, lag(cue_id) OVER {LINE} AS before, lag(start_ms) OVER {LINE} AS ps, lag(end_ms) OVER {LINE} AS pe FROM v_cues)
SELECT ep, 'cue' AS row, NULL AS kind, cue_id::VARCHAR AS cue_ids, start_ms, end_ms, NULL AS new_text FROM r
UNION ALL SELECT ep, 'finding', kind, before || ',' || cue_id, start_ms, end_ms, format('{{:.3f}} --> {{:.3f}}', start_ms / 1000.0::DOUBLE, end_ms / 1000.0::DOUBLE) FROM r WHERE kind IS NOT NULL
UNION ALL SELECT ep, 'finding', 'output_order_inversion', before || ',' || cue_id, least(ps, start_ms), greatest(pe, end_ms), NULL FROM inv WHERE start_ms < ps"""


@query(SORTED)
def finalize_turns(spark, sf):
    """W10, W15, L1 over whole turns: no two are alike, so order and overlaps alone act."""
    from ..operators.finalize import Finish, finalize

    d = finalize(cues(spark, sf), Finish(alike=101.0))
    return d.select("ep", "row", "kind", F.array_join(F.coalesce("cue_ids", F.array("cue_id")), ",").alias("cue_ids"), "start_ms", "end_ms", F.when(F.col("row") == "finding", F.col("new_text")).alias("new_text"))


@query(f", p AS (SELECT *, lag(cue_id) OVER {LINE} AS before, lag(text) OVER {LINE} AS pt, lag(start_ms) OVER {LINE} AS ps, lag(end_ms) OVER {LINE} AS pe FROM v_cues) SELECT ep, 'overlap_stacked' AS kind, before || ',' || cue_id AS cue_ids, greatest(ps, start_ms) AS start_ms, least(pe, end_ms) AS end_ms, pt || chr(10) || text AS old_text FROM p WHERE start_ms < pe")
def overlap_findings(spark, sf):
    """Cues that begin before the last one ends."""
    from ..operators.finalize import findings_of, overlap_policy

    return findings_of(overlap_policy(cues(spark, sf))).select("ep", "kind", F.array_join("cue_ids", ",").alias("cue_ids"), "start_ms", "end_ms", "old_text")


@query()
def sync_findings(spark, sf):
    """A whole re-timing with its end: every finding by kind and severity."""
    from . import flows

    c = cues(spark, sf)
    return flows.finished(flows.sync(c, _recognised(spark, sf)), c)[1]


@query()
def job_story(spark, sf):
    """R3-R5 over users as jobs: every change, refusal and deadline, as the stream tells it."""
    from ..streaming.jobs import Lifetimes, job_changes

    kinds = {"view": "queue", "click": "claim", "purchase": "complete", "add_to_cart": "fail"}
    kind = F.coalesce(*(F.when(F.col("text") == k, v) for k, v in kinds.items()), F.lit("interrupt"))
    e = words(spark, sf).select(F.col("ep").alias("job_id"), "event_id", F.col("start_us").alias("ts_us"), kind.alias("event"))
    return job_changes(e, 800 * HOUR, Lifetimes(12 * HOUR, 24 * HOUR))


@query(r"""SELECT doc_id AS ep, len(l) - (l[-1] = '')::INT AS lines, CASE WHEN len(l) - (l[-1] = '')::INT > 40 THEN 'more than 40 lines' WHEN len(list_filter(l, lambda x: strlen(x) > 2000)) > 0 THEN format('line {} is longer than 2000 bytes', list_position([strlen(x) > 2000 FOR x IN l], true)) END AS problem
FROM (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents)""")
def scan_uploads(spark, sf):
    """S24 over documents as uploads, in chunks of 4 KiB."""
    from ..sources.scanner import chunked, scan_chunks

    d = read(spark, sf, "documents").select(F.col("doc_id").alias("ep"), F.encode("text", "UTF-8").alias("content"))
    return scan_chunks(chunked(d, 4096), 40, 2000)


# ---- pairs that there are, drift between roles


SPOKEN = rf""", tk AS (SELECT ep, pos, cue_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS i FROM v_cues), nt AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY pos, i) - 1 AS idx FROM tk)
"""


@query(SPOKEN + """, l AS (SELECT ep, token, min(idx) AS left_idx FROM nt GROUP BY ALL HAVING count(*) = 1), h AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY idx) - 1 AS word_idx FROM nt WHERE idx % 7 <> 3),
r AS (SELECT ep, token, min(word_idx) AS right_idx FROM h GROUP BY ALL HAVING count(*) = 1), j AS (SELECT ep, token, left_idx, right_idx FROM l JOIN r USING (ep, token)), o AS (SELECT *, coalesce(right_idx < lag(right_idx) OVER (PARTITION BY ep ORDER BY left_idx), false) AS falls FROM j)
SELECT ep, token, left_idx, right_idx FROM o QUALIFY NOT bool_or(falls) OVER (PARTITION BY ep)""")
def spoken_pairs(spark, sf):
    from . import flows

    heard = _spoken(spark, sf).select("ep", F.col("word_idx").alias("idx"), F.col("text").alias("token"))
    return align.exact_pairs(flows.cue_tokens(cues(spark, sf)).select("ep", "idx", "token"), heard)


ENDED_SQL = r"""[.!?]["''»“”„’)\]]*\s*$"""
DRIFT_WORDS = rf"""c AS (SELECT ep, pos, cue_id, speaker, regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+') AS w, string_split_regex(p, '[\p{{L}}\p{{N}}_]+') AS b FROM (SELECT *, {PLAIN} AS p FROM v_cues)),
k AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(b[-1], '{ENDED_SQL}') THEN true WHEN len(w) > 0 THEN false END IGNORE NULLS) OVER (PARTITION BY ep, speaker ORDER BY pos, cue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS carried FROM c),
o AS (SELECT ep, pos, cue_id, speaker, i, token, translate(replace(lower(token), 'ß', 'ss'), 'ſς', 'sσ') AS key, regexp_matches(b[i], '{ENDED_SQL}') OR (i = 1 AND carried) AS initial FROM (SELECT *, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM k)),
f AS (SELECT ep, key, token, count(*) AS n, min((pos, cue_id, i)) AS first, bool_or(regexp_matches(substr(token, 1, 1), '^\p{{Lu}}') AND NOT initial) AS name FROM o WHERE speaker = 'user' GROUP BY ALL),
known AS (SELECT ep, key AS known, sum(n) AS n, first(token ORDER BY n DESC, first) AS token, min(first) AS first, bool_or(name) AS name FROM f GROUP BY ep, key),
new AS (SELECT ep, key, first(token ORDER BY pos, cue_id, i) AS new_text, list_sort(list(DISTINCT cue_id)) AS cue_ids FROM o WHERE speaker = 'assistant' AND length(key) >= 4 AND (ep, key) NOT IN (SELECT (ep, known) FROM known) GROUP BY ep, key),
p AS (SELECT new.ep, key, known, length(key) AS la, length(known) AS lb, list_reduce(list_prepend([0 FOR j IN range(length(known) + 1)], [[unicode(x)] FOR x IN string_split(key, '')]), lambda row, x: list_prepend(0, [list_max([greatest(row[k + 1], row[k] + (unicode(substr(known, k, 1)) = x[1])::INT) FOR k IN range(1, j + 1)]) FOR j IN range(1, length(known) + 1)]))[-1] AS lcs
  FROM new JOIN known ON new.ep = known.ep AND n >= 2 AND abs(length(key) - length(known)) <= 3),
r AS (SELECT p.*, k.n, k.token, k.name, row_number() OVER (PARTITION BY ep, key ORDER BY n DESC, 200.0 * lcs / (la + lb) DESC, first) AS r, sum(n) OVER (PARTITION BY ep, key) AS all_n FROM p JOIN known k USING (ep, known) WHERE 200 * lcs >= 70 * (la + lb))
"""


@query(", " + DRIFT_WORDS + """SELECT ep, CASE WHEN name THEN 'name_spelling_inconsistency' ELSE 'unsourced_word_substitution' END AS kind, 'warning' AS severity, array_to_string(cue_ids, ',') AS cue_ids,
  format('Output spelling ''{}'' is absent from the source, while near spelling ''{}'' appears {} times; review as {}.', new_text, token, n::BIGINT, CASE WHEN name THEN 'a possible name drift' ELSE 'an unsourced word substitution' END) AS message, token AS old_text, new_text
FROM r JOIN new USING (ep, key) WHERE r = 1 AND n / all_n >= 0.8""")
def name_drift_roles(spark, sf):
    """J18 by episode: what the assistant spells unlike the user."""
    from ..operators.name_drift import name_drift_findings

    c = cues(spark, sf)
    d = name_drift_findings(c.where("speaker = 'user'"), c.where("speaker = 'assistant'"))
    return d.withColumn("cue_ids", F.array_join("cue_ids", ","))


@query(", " + DRIFT_WORDS + "SELECT ep, speaker, cue_id, (i - 1)::INT AS i, token, initial FROM o")
def sentence_starts(spark, sf):
    """The words of every speaker's cues and which of them begin a sentence."""
    from ..operators.name_drift import occurrences

    c = cues(spark, sf).withColumn("ep", F.struct("ep", "speaker"))
    return occurrences(c).select("ep.ep", "ep.speaker", "cue_id", "i", "token", "initial")


# ---- cues against words and speech


@query(f""", m AS (SELECT ep, word_idx, word_idx % 12 + 1 AS cue_id, (event_id % 64) / 64 AS confidence FROM v_words), h AS (SELECT ep, cue_id, avg(confidence) AS heard FROM m GROUP BY ALL), f AS (SELECT ep, cue_id, (cue_id * 37 % 101) / 100 AS forced FROM v_cues WHERE cue_id % 4 = 1)
SELECT s.ep, s.cue_id, s.cps, round(coalesce(forced, heard, 0), 4) AS score, CASE WHEN forced IS NOT NULL THEN 'forced_alignment' WHEN heard IS NOT NULL THEN 'asr_confidence' ELSE 'unscored' END AS source FROM speed s LEFT JOIN h ON h.ep = s.ep AND h.cue_id = s.cue_id LEFT JOIN f ON f.ep = s.ep AND f.cue_id = s.cue_id""".replace(", m AS", CPS + ", m AS", 1))
def cue_scores(spark, sf):
    from ..operators import refinement

    w, c = words(spark, sf).withColumn("confidence", F.col("event_id") % 64 / 64), cues(spark, sf)
    forced = c.where("cue_id % 4 = 1").select("ep", "cue_id", (F.col("cue_id") * 37 % 101 / 100).alias("score"), F.lit(0).alias("seq"))
    return refinement.cue_scores(c, w.select("ep", (F.col("word_idx") % 12 + 1).alias("cue_id"), "word_idx"), w, forced, width())


@query(SPOKEN + "SELECT ep, round(count(*) FILTER (idx % 7 <> 3) / count(*), 4) AS coverage FROM nt GROUP BY ep")
def anchor_coverage(spark, sf):
    from ..operators import refinement
    from . import flows

    heard = _spoken(spark, sf).select("ep", F.col("word_idx").alias("idx"), F.col("text").alias("token"))
    return refinement.anchor_coverage(align.align_tokens(flows.cue_tokens(cues(spark, sf)).select("ep", "idx", "token"), heard))


SPEECH = ", sp AS (SELECT ep, pos AS region_idx, start_ms * 1000 + 217000 AS start_us, greatest(end_ms * 1000 - 390000, start_ms * 1000 + 217000) AS end_us FROM v_cues WHERE pos % 3 <> 2)\n"


def _speech(spark, sf):
    d = cues(spark, sf).where("pos % 3 <> 2").withColumn("start_us", F.col("start_ms") * 1000 + 217_000)
    return d.select("ep", F.col("pos").alias("region_idx"), "start_us", F.greatest(F.col("end_ms") * 1000 - 390_000, F.col("start_us")).alias("end_us"))


@query(SPEECH + """, cov AS (SELECT c.ep, c.cue_id, c.start_ms, c.end_ms, coalesce(sum(least(sp.end_us, c.end_ms * 1000) - greatest(sp.start_us, c.start_ms * 1000)) FILTER (sp.ep IS NOT NULL), 0) / ((c.end_ms - c.start_ms) * 1000.0::DOUBLE) AS share, max(sp.end_us) AS last
  FROM v_cues c LEFT JOIN sp ON sp.ep = c.ep AND sp.start_us < c.end_ms * 1000 AND c.start_ms * 1000 < sp.end_us GROUP BY c.ep, c.cue_id, c.start_ms, c.end_ms),
tail AS (SELECT *, least(last, end_ms * 1000) AS cut, round_even((end_ms * 1000 - least(last, end_ms * 1000)) / 1000.0::DOUBLE, 0)::BIGINT AS ms FROM cov WHERE last IS NOT NULL)
SELECT ep, 'cue_without_speech_activity' AS kind, cue_id, format('Cue overlaps speech activity for only {}% of its duration.', round_even(share * 100, 0)::INT) AS message, round(share, 3) AS confidence, start_ms / 1000.0::DOUBLE AS start, end_ms / 1000.0::DOUBLE AS "end" FROM cov WHERE share < 0.9
UNION ALL SELECT ep, 'cue_with_excessive_trailing_silence', cue_id, format('Cue remains visible for {} ms after the last detected speech activity; limit is 300 ms.', ms), NULL, cut / 1e6, end_ms / 1000.0::DOUBLE FROM tail WHERE ms > 300""")
def speech_flags(spark, sf):
    """A8 and W23 as findings."""
    from ..operators.findings import speech_findings

    d = speech_findings(cues(spark, sf), _speech(spark, sf), 4_000_000, 0.9)
    return d.select("ep", "kind", F.get("cue_ids", 0).alias("cue_id"), "message", "confidence", "start", "end")


@query(SPEECH + "SELECT sp.ep, region_idx, list(cue_id ORDER BY pos)[1] AS first_cue, list(cue_id ORDER BY pos)[-1] AS last_cue, count(*) AS n FROM sp JOIN v_cues c ON c.ep = sp.ep AND c.start_ms * 1000 < sp.end_us AND sp.start_us < c.end_ms * 1000 GROUP BY ALL")
def region_cues(spark, sf):
    from ..operators import refinement

    d = refinement.region_cues(cues(spark, sf), _speech(spark, sf), 4_000_000)
    return d.select("ep", "region_idx", F.get("cue_ids", 0).alias("first_cue"), F.element_at("cue_ids", -1).alias("last_cue"), F.size("cue_ids").cast("long").alias("n"))


HEARD = ", hw AS (SELECT ep, cue_id, start_ms * 1000 + 150000 AS a_s, start_ms * 1000 + 420000 AS a_e, end_ms * 1000 - 700000 + cue_id * 13000 AS z_s, end_ms * 1000 - CASE WHEN cue_id % 8 = 0 THEN -2500000 ELSE 250000 END + cue_id * 13000 AS z_e FROM v_cues WHERE cue_id % 2 = 0)\n"


def _heard(spark, sf):
    """Two words for every second cue: one soon after its start, one around its end, at times far too long."""
    c = cues(spark, sf).where("cue_id % 2 = 0")
    start, end = F.col("start_ms") * 1000, F.col("end_ms") * 1000 + F.col("cue_id") * 13_000
    two = F.array(F.struct((start + 150_000).alias("s"), (start + 420_000).alias("e")), F.struct((end - 700_000).alias("s"), (end - F.when(F.col("cue_id") % 8 == 0, -2_500_000).otherwise(250_000)).alias("e")))
    return c.select("ep", "cue_id", F.posexplode(two).alias("i", "w")).select("ep", "cue_id", (F.col("cue_id") * 2 + F.col("i")).cast("long").alias("word_idx"), F.col("w.s").cast("long").alias("start_us"), F.col("w.e").cast("long").alias("end_us"))


def _refine_sql() -> str:
    holds = lambda t: f"(SELECT min({{'s': r.start_us, 'e': r.end_us}}) FROM sp r WHERE r.ep = c.ep AND r.start_us <= {t} AND {t} <= r.end_us)"
    meets = lambda how, a, b: f"(SELECT {how}({{'s': r.start_us, 'e': r.end_us}}) FROM sp r WHERE r.ep = c.ep AND r.end_us > {a} AND r.start_us < {b})"
    first, last = "least({'s': a_s, 'e': a_e}, {'s': z_s, 'e': z_e})", "greatest({'s': a_s, 'e': a_e}, {'s': z_s, 'e': z_e})"
    return SPEECH + HEARD + f"""
, j AS (SELECT c.*, h.cue_id IS NOT NULL AS heard, {first} AS a, {last} AS z FROM v_cues c LEFT JOIN hw h ON h.ep = c.ep AND h.cue_id = c.cue_id),
k AS (SELECT c.*, z.e - z.s > 2000000 AS odd, {holds("a.s")} AS a0, {meets("min", "a.s", "a.e")} AS a1, {holds("z.s")} AS zs, {holds("z.e")} AS ze, {meets("min", "z.s", "z.e")} AS z2, {meets("min", "c.start_ms * 1000", "c.end_ms * 1000")} AS c0, {meets("max", "c.start_ms * 1000", "c.end_ms * 1000")} AS c1 FROM j c),
f AS (SELECT *, CASE WHEN heard THEN coalesce(a0, a1) ELSE c0 END AS r0, CASE WHEN heard THEN coalesce(CASE WHEN odd THEN zs ELSE ze END, zs, z2) ELSE c1 END AS r1, lead(start_ms) OVER {LINE} AS cap FROM k),
g AS (SELECT *, r0.s // 1000 AS begins, r1.e // 1000 AS stops FROM f),
p AS (SELECT *, CASE WHEN begins - start_ms <= 150 THEN start_ms ELSE greatest(0, {floor_sql("begins - 40")}) END AS s, {ceil_sql("stops + 40")} AS padded, {ceil_sql("z.e / 1000.0::DOUBLE + 40")} AS spoken FROM g),
q AS (SELECT *, CASE WHEN heard THEN CASE WHEN odd THEN padded WHEN end_ms < spoken THEN spoken WHEN end_ms < padded AND padded - spoken <= 300 THEN padded WHEN end_ms - spoken > 300 THEN greatest(spoken, least(end_ms, padded)) ELSE end_ms END
 ELSE CASE WHEN (stops - end_ms > 40 AND stops - end_ms <= 300) OR end_ms - padded > 300 THEN padded ELSE end_ms END END AS e0 FROM p),
t AS (SELECT *, greatest(least(e0, coalesce(cap, e0)), {ceil_sql("s + 500")}) AS e1 FROM q),
u AS (SELECT *, CASE WHEN e1 > cap THEN greatest(s, cap) ELSE e1 END AS e2, r0 IS NOT NULL AND r1 IS NOT NULL AS found FROM t),
v AS (SELECT *, CASE WHEN found THEN s ELSE start_ms END AS new_start, CASE WHEN found THEN e2 ELSE end_ms END AS new_end FROM u)
SELECT ep, pos, cue_id, new_start, new_end, new_start <> start_ms OR new_end <> end_ms AS refined, found AND new_end - new_start < 500 AS too_short FROM v"""


@query(_refine_sql())
def refine_boundaries(spark, sf):
    from ..operators import refinement

    w = _heard(spark, sf)
    return refinement.refine_boundaries(cues(spark, sf), _speech(spark, sf), w.select("ep", "cue_id", "word_idx"), w.select("ep", "word_idx", "start_us", "end_us"), 4_000_000)


# ---- decisions, signs, masks


def _cases(spark, sf):
    """Cases over the cues: replaced, shortened and emptied spans, and generated text between and within cues."""
    off = F.coalesce(F.sum(F.size("sig")).over(sequence.by("pos").rowsBetween(sequence.Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    c = cues(spark, sf).withColumn("sig", tx.signature(tx_plain())).withColumn("offset", off).where("cue_id % 2 = 0 and size(sig) > 1")
    kind = (F.col("pos") + F.col("ep")) % 5
    own = F.when(kind < 4, F.array("cue_id")).otherwise(F.array().cast("array<long>"))
    idx = F.when(kind < 3, F.transform(F.sequence(F.lit(1), F.when(kind == 1, F.lit(1)).otherwise(F.size("sig") - 1)), lambda i: F.col("offset") + i)).otherwise(F.array().cast("array<long>"))
    said = F.when(kind == 0, F.lit("quite different words")).when(kind == 1, F.lit("")).when(kind == 2, F.concat(F.get("sig", 0), F.lit(" and so on."))).when(kind == 3, F.lit("all of it anew, please")).otherwise(F.lit("oh no"))
    sec = lambda x: x / 1000.0
    return c.select(
        "ep", F.row_number().over(sequence.by("pos")).cast("long").alias("nth"), F.concat(F.lit("case-"), F.col("pos")).alias("case_id"), F.when(F.col("pos") % 7 == 0, "keep_srt").otherwise("use_audio").alias("verdict"), said.alias("final_text"), F.lit(0.9).alias("confidence"),
        own.alias("cue_ids"), F.when(kind < 3, F.array_join(F.slice("sig", 2, F.when(kind == 1, F.lit(1)).otherwise(F.size("sig") - 1)), " ")).otherwise(F.lit("")).alias("srt_text"), said.alias("asr_text"), idx.alias("token_idx"), F.array(F.col("pos"), F.col("pos") + 1).alias("word_idx"),
        sec(F.col("end_ms") + 30).alias("start"), sec(F.col("end_ms") + 400).alias("end"), F.array(F.col("speaker")).alias("speaker_ids"), F.when(kind == 4, F.col("cue_id")).alias("left_cue"), F.when((kind == 4) & (F.col("pos") % 2 == 0), F.col("cue_id")).alias("right_cue"), F.when((kind == 4) & (F.col("pos") % 2 == 0), F.lit(1).cast("long")).alias("insert_at"),
        sec(F.col("end_ms")).alias("left_end"), F.lit(None).cast("double").alias("right_start"), F.col("speaker").alias("left_speaker"), F.lit(None).cast("string").alias("right_speaker"),
    )


@query()
def place_generated(spark, sf):
    from ..operators import apply_decisions as ad

    c = cues(spark, sf)
    return ad.placements(c, kept(_cases(spark, sf), "cases"), c.where("cue_id % 4 = 0"), 10_000_000)


@query()
def apply_decisions(spark, sf):
    from ..operators import apply_decisions as ad

    c, cases = cues(spark, sf), kept(_cases(spark, sf), "cases")
    return ad.apply_decisions(c, cases, kept(ad.placements(c, cases, c.where("cue_id % 4 = 0"), 10_000_000), "placed"))[0]


@query()
def decision_flags(spark, sf):
    from ..operators import apply_decisions as ad

    c, cases = cues(spark, sf), kept(_cases(spark, sf), "cases")
    flags = ad.apply_decisions(c, cases, kept(ad.placements(c, cases, c.where("cue_id % 4 = 0"), 10_000_000), "placed"), drop_policy="remove")[1]
    return flags.select("ep", "nth", "kind", "severity", F.get("cue_ids", 0).alias("cue_id"), "message", "confidence", "start", "end", "old_text", "new_text")


@query("SELECT ep, cue_id, CASE WHEN cue_id % 4 = 1 THEN text || '!' ELSE text END AS text, CASE cue_id % 4 WHEN 2 THEN 'words changed' WHEN 3 THEN 'quotation marks changed' END AS problem FROM v_cues")
def punctuate(spark, sf):
    from ..operators import punctuation

    c = cues(spark, sf)
    new = F.when(F.col("cue_id") % 4 == 1, F.concat("text", F.lit("!"))).when(F.col("cue_id") % 4 == 2, F.concat("text", F.lit(" more"))).otherwise(F.concat(F.lit("“"), "text", F.lit("”")))
    return punctuation.punctuate(c, c.where("cue_id % 4 <> 0").select("ep", "cue_id", new.alias("proposed")))


def _profane(spark, sf):
    words_ = F.array(*map(F.lit, ("Scheisse", "so ein Mist", "Idiot", "verdammte", "Arschloch")))
    c = cues(spark, sf).select("ep", "pos", "cue_id", F.concat(F.get(words_, (F.col("pos") % 7).cast("int")), F.lit(", "), "text").alias("t"), "text")
    return c.select("ep", "pos", "cue_id", F.coalesce("t", "text").alias("text"))


@query("SELECT ep, pos, cue_id, CASE pos % 7 WHEN 0 THEN 'Sch*isse, ' WHEN 1 THEN 'so ein M*st, ' WHEN 2 THEN 'Id*ot, ' WHEN 3 THEN 'verd*mmte, ' WHEN 4 THEN '*rschloch, ' ELSE '' END || text AS text, CASE pos % 7 WHEN 0 THEN 'Scheisse>Sch*isse' WHEN 1 THEN 'Mist>M*st' WHEN 2 THEN 'Idiot>Id*ot' WHEN 3 THEN 'verdammte>verd*mmte' WHEN 4 THEN 'Arschloch>*rschloch' ELSE '' END AS changes FROM v_cues")
def censor_cues(spark, sf):
    from ..operators import punctuation

    return punctuation.censor_cues(_profane(spark, sf))


@query("SELECT ep, cue_id, word_idx FROM (SELECT ep, word_idx // 3 AS cue_id, word_idx FROM v_words WHERE word_idx % 2 = 0 UNION SELECT ep, CASE WHEN word_idx % 5 < 3 THEN word_idx // 5 ELSE word_idx // 5 + 1000 END, word_idx FROM v_words)")
def attach_words(spark, sf):
    from ..operators import apply_decisions as ad

    w = words(spark, sf)
    spans = w.groupBy("ep", F.floor(F.col("word_idx") / 5).alias("nth")).agg(F.array_sort(F.collect_list("word_idx")).alias("word_idx"), F.max("word_idx").alias("top"))
    spans = spans.withColumn("word_idx", F.sequence(F.col("nth") * 5, F.col("nth") * 5 + 4)).select("ep", "nth", F.lit("use_audio").alias("verdict"), F.array(F.col("nth"), F.col("nth") + 1000).alias("cue_ids"), "word_idx")
    none = spans.select("ep", "nth", F.lit(None).cast("long").alias("cue_id")).where("false")
    got = ad.attach_words(w.where("word_idx % 2 = 0").select("ep", F.floor(F.col("word_idx") / 3).alias("cue_id"), "word_idx"), spans, none)
    return got.join(w.select("ep", "word_idx"), ["ep", "word_idx"], "left_semi").select("ep", "cue_id", "word_idx")


@query("SELECT ep, 'case-' || pos AS case_id, CASE WHEN pos % 4 = 3 OR length(text) % 6 = 5 THEN 'keep_srt' ELSE 'hybrid' END AS verdict, CASE WHEN pos % 4 = 3 OR length(text) % 6 = 5 THEN 0.0 ELSE 0.75 END AS confidence FROM v_cues")
def validated_decisions(spark, sf):
    from ..operators import apply_decisions as ad

    spans = cues(spark, sf).select("ep", F.concat(F.lit("case-"), F.col("pos")).alias("case_id"), F.col("text").alias("srt_text"), F.col("pos").alias("p"), F.length("text").alias("n"))
    answer = lambda d: d.select("ep", "case_id", F.when(F.col("n") % 6 == 5, "nonsense").otherwise("hybrid").alias("verdict"), F.lit("x").alias("final_text"), F.lit(0.75).alias("confidence"))
    return ad.validate(spans, answer(spans.where("p % 2 = 0")), lambda lost: answer(lost.where("p % 4 <> 3")))[0].select("ep", "case_id", "verdict", "confidence")


# ---- what runs leave and ask


@query("SELECT ep, speaker, cue_id, row_number() OVER (PARTITION BY ep, speaker ORDER BY pos) AS nth FROM v_cues WHERE speaker <> '' QUALIFY nth <= 8")
def speaker_samples(spark, sf):
    from ..operators import prompts

    return prompts.speaker_samples(cues(spark, sf)).select("ep", "speaker", "cue_id", "nth")


@query("SELECT ep, sum(speakers)::BIGINT AS speakers, sum(samples)::BIGINT AS samples FROM (SELECT ep, 1 AS speakers, least(count(*), 8) AS samples FROM v_cues WHERE speaker <> '' GROUP BY ep, speaker) GROUP BY ep")
def speaker_payloads(spark, sf):
    from ..operators import prompts

    told = F.from_json("payload", "struct<speakers:array<struct<speaker_id:string,samples:array<struct<cue_id:bigint,text:string>>>>>")["speakers"]
    d = prompts.speakers(cues(spark, sf)).withColumn("s", told)
    return d.select("ep", F.size("s").cast("long").alias("speakers"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.size(x["samples"])).alias("samples"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'hit ' || doc_id END AS value FROM documents")
def cached_results(spark, sf):
    from ..operators import edits
    from ..sources import artefacts

    keyed = edits.cache_keys(read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    old = keyed.where("doc_id % 3 = 1").select("digest", F.lit("old").alias("value"))
    fresh = keyed.where("doc_id % 3 <> 0").select("digest", F.concat(F.lit("hit "), "doc_id").alias("value"))
    hits, misses = artefacts.cached(keyed, artefacts.merged_cache(old, fresh))
    return hits.select("doc_id", "value").unionByName(misses.select("doc_id", F.lit(None).cast("string").alias("value")))


@query(LINT + """, s AS (SELECT ep, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) AS n FROM lint GROUP BY ep), o AS (SELECT ep, count(*) AS f FROM (SELECT ep, lag(end_ms) OVER (PARTITION BY ep ORDER BY pos) > start_ms AS x FROM v_cues) WHERE x GROUP BY ep),
c AS (SELECT ep, count(*) AS cue_count FROM v_cues GROUP BY ep)
SELECT c.ep, cue_count, coalesce(f, 0) AS flags, coalesce(n, 0) AS style_violations, coalesce(e, 0) AS error_count, coalesce(w, 0) + coalesce(f, 0) AS warning_count FROM c LEFT JOIN s ON s.ep = c.ep LEFT JOIN o ON o.ep = c.ep""")
def report_summary(spark, sf):
    from ..sources import artefacts

    c = cues(spark, sf)
    flags = sequence.overlap_flags(c).select("ep", F.row_number().over(sequence.by("right_id")).alias("rank"), F.lit("warning").alias("severity"), F.lit("overlap").alias("kind"), F.array("left_id", "right_id").alias("cue_ids"), F.lit("<cues overlap>").alias("message"), F.lit(None).cast("string").alias("old_text"), F.lit(None).cast("string").alias("new_text"))
    scores = c.select("ep", "cue_id", F.lit(1.0).alias("cps"), F.lit(0.5).alias("score"), F.lit("unscored").alias("source"))
    told = F.from_json("json", "struct<summary:struct<cue_count:bigint,flags:bigint,style_violations:bigint,error_count:bigint,warning_count:bigint>>")["summary"]
    return artefacts.report(c, flags, _flags(spark, sf).drop("start_ms"), scores).select("ep", told.alias("s")).select("ep", "s.*")


@query(r"""SELECT ep, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || '# text_changed cue=' || cue_id || chr(10) || array_to_string(['- ' || x FOR x IN string_split(text, chr(10))], chr(10)) || chr(10) || '+ new', chr(10) || chr(10) ORDER BY n) || chr(10) AS srt
FROM (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY start_ms, end_ms, pos) AS n FROM v_cues) GROUP BY ep""")
def changes_srt(spark, sf):
    from ..sources import artefacts

    f = cues(spark, sf).select("ep", F.col("pos").alias("nth"), F.lit("text_changed").alias("kind"), F.array("cue_id").alias("cue_ids"), F.col("text").alias("old_text"), F.lit("new").alias("new_text"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    return artefacts.changes_srt(f)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars + 1 ELSE 0 END AS tokens_in, CASE doc_id % 3 WHEN 0 THEN 7 WHEN 1 THEN doc_id ELSE 0 END::BIGINT AS tokens_out FROM documents")
def usage_tokens(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars")
    kind = F.col("doc_id") % 3
    told = F.when(kind == 0, F.format_string('{"usage": {"prompt_tokens": %d, "completion_tokens": 7}}', "n_chars")).when(kind == 1, F.format_string('{"usage_metadata": {"prompt_token_count": %d, "candidates_token_count": %d}}', F.col("n_chars") + 1, F.col("doc_id"))).otherwise(F.lit("{}"))
    used = quality_control.usage(told)
    return d.select("doc_id", used[0].alias("tokens_in"), used[1].alias("tokens_out"))
