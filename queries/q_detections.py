from pyspark.sql import functions as F

from framesift.functions import boxes as B
from framesift.operators import detections as D
from framesift.operators import tracking as K
from queries import views
from queries.q_stats import rounded
from queries.registry import query
from queries.views import CATEGORIES, det, patches, table, with_views


def iou_sql(a="a.", b="b."):
    inter = (f"(greatest(least({a}xmax,{b}xmax)-greatest({a}xmin,{b}xmin),0)*greatest(least({a}ymax,{b}ymax)-greatest({a}ymin,{b}ymin),0))")
    area = lambda p: f"(({p}xmax-{p}xmin)*({p}ymax-{p}ymin))"
    return f"({inter}/({area(a)}+{area(b)}-{inter}))"


def giou_sql(a="a.", b="b."):
    inter = f"(greatest(least({a}xmax,{b}xmax)-greatest({a}xmin,{b}xmin),0)*greatest(least({a}ymax,{b}ymax)-greatest({a}ymin,{b}ymin),0))"
    union = f"(({a}xmax-{a}xmin)*({a}ymax-{a}ymin)+({b}xmax-{b}xmin)*({b}ymax-{b}ymin)-{inter})"
    hull = f"((greatest({a}xmax,{b}xmax)-least({a}xmin,{b}xmin))*(greatest({a}ymax,{b}ymax)-least({a}ymin,{b}ymin)))"
    return f"({inter}/{union} - ({hull}-{union})/{hull})"


@query("P5_confident", with_views("det", body="SELECT event_id FROM det WHERE confidence > 0.5"))
def p5(spark, d):
    return D.confident(det(spark, d)).select("event_id")


@query("P6_box_shapes", with_views("det", body="""
SELECT event_id, xmax-xmin AS width, ymax-ymin AS height, round((ymax-ymin)/(xmax-xmin), 8) AS ratio, (ymax-ymin)*(xmax-xmin) AS area FROM det"""))
def p6(spark, d):
    return rounded(D.box_shapes(det(spark, d)).select("event_id", "width", "height", "ratio", "area"), "ratio", places=8)


BAD = ((100.0, 100.0, 200.0, 180.0), (0.0, 0.0, 900.0, 500.0), (400.0, 250.0, 480.0, 330.0))


@query("P7_blacklist_iou", with_views("det", body=f"""
SELECT event_id, cast(b.bad_id AS int) AS bad_id, round({iou_sql()}, 8) AS iou FROM det a,
  (VALUES (0, 100::double, 100::double, 200::double, 180::double), (1, 0, 0, 900, 500), (2, 400, 250, 480, 330)) b(bad_id, xmin, ymin, xmax, ymax)"""))
def p7(spark, d):
    return rounded(D.blacklist_iou(det(spark, d), BAD).select("event_id", "bad_id", "iou"), "iou", places=8)


@query("P8_filter_tracks", with_views("det", body=f"""
SELECT event_id, track_id FROM det WHERE category = 'view' AND track_id IN (SELECT track_id FROM (
  SELECT a.track_id, count(*) AS n, median(a.ymax-a.ymin) AS h, median(a.xmax-a.xmin) AS w, median((a.ymax-a.ymin)/(a.xmax-a.xmin)) AS r, median({iou_sql()}) AS i
  FROM det a, (SELECT 100::double AS xmin, 100::double AS ymin, 420::double AS xmax, 300::double AS ymax) b WHERE category = 'view' GROUP BY 1)
  WHERE n > 2 AND h > 45 AND w > 50 AND r > 0.5 AND r < 1.5 AND i < 0.03)"""))
def p8(spark, d):
    return D.filter_tracks(det(spark, d), "view", ratio=(.5, 1.5), width_above=50, height_above=45,
                           bad_boxes=[((100, 100, 420, 300), .03)]).select("event_id", "track_id")


@query("P9_corner_boxes", with_views("det", body="""
SELECT event_id, round((cx-w/2)*1280, 6) AS xmin, round((cy-h/2)*720, 6) AS ymin, round((cx+w/2)*1280, 6) AS xmax, round((cy+h/2)*720, 6) AS ymax
FROM (SELECT event_id, (xmin+xmax)/2/1000 AS cx, (ymin+ymax)/2/600 AS cy, (xmax-xmin)/1000 AS w, (ymax-ymin)/600 AS h FROM det)"""))
def p9(spark, d):
    x1, y1, x2, y2 = B.box()
    corners = B.from_center((x1 + x2) / 2 / 1000, (y1 + y2) / 2 / 600, (x2 - x1) / 1000, (y2 - y1) / 600, 1280, 720)
    return det(spark, d).select("event_id", *[F.round(c, 6).alias(n) for c, n in zip(corners, B.CORNERS)])


@query("P10_best_class", with_views("patches", body="""
SELECT patch_id, cast(list_position(r, list_max(r)) - 1 AS int) AS class, round(exp(list_max(r)) / list_sum(list_transform(l, lambda x: exp(x))), 6) AS score
FROM (SELECT patch_id, l, l[1:9] AS r FROM (SELECT patch_id, list_transform(embedding[1:10], lambda x: x::double * 10) AS l FROM patches))"""))
def p10(spark, d):
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10)
    p = patches(spark, d).withColumn("l", logits)
    cls, score = B.best_class(F.col("l"))
    return p.select("patch_id", cls.alias("class"), F.round(score, 6).alias("score"))


views.define("cascade", """SELECT event_id, mode, CASE WHEN d > td AND s > ts THEN 6 WHEN d > td THEN 4 ELSE 2 END AS status,
    d AS diff_score, CASE WHEN d > td THEN s ELSE 0 END AS small_score, CASE WHEN d > td AND s > ts THEN y ELSE 0 END AS detector_score
  FROM (SELECT e.event_id, cast(json_extract_string(props, '$.k') AS double)/100 AS d, confidence AS s, CASE WHEN track_id % 7 = 0 THEN 1.0::double ELSE 0 END AS y
        FROM events e JOIN det ON det.event_id = e.event_id),
  (VALUES ('diff', 'inf'::double, 'inf'::double), ('diff_small', -1, 'inf'::double), ('everything', -1, -1), ('measured', 0.3, 0.4)) m(mode, td, ts)""", "det")


def cascaded(spark, d):
    k = table(spark, d, "events").select("event_id", (F.get_json_object("props", "$.k").cast("double") / 100).alias("d"))
    # Rows meet once, whatever the number of modes; a table of one row per event is never small enough to be broadcast.
    rows = det(spark, d).select("event_id", "track_id", "confidence").join(k.hint("merge"), "event_id")
    y = F.when(F.col("track_id") % 7 == 0, 1.0).otherwise(0.0)
    return D.cascades(rows, D.CASCADE_MODES, F.col("d"), F.col("confidence"), y, (0.3, 0.4))


@query("P11_cascade", with_views("cascade", body="""
SELECT event_id, mode, status, round(diff_score, 6) AS diff_score, round(small_score, 6) AS small_score, detector_score FROM cascade"""))
def p11(spark, d):
    return rounded(cascaded(spark, d).select("event_id", "mode", "status", "diff_score", "small_score", "detector_score"), "diff_score", "small_score")


@query("P12_cascade_share", with_views("cascade", body="""
SELECT status, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS pct FROM cascade WHERE mode = 'measured' GROUP BY 1"""))
def p12(spark, d):
    return rounded(D.cascade_share(cascaded(spark, d).where("mode = 'measured'")), "pct")


@query("P13_label_combinations", with_views("det", extra="""
c AS (SELECT frame_id, count(*) FILTER (category='click') AS click, count(*) FILTER (category='error') AS error FROM det GROUP BY 1),
o AS (SELECT *, md5('1:' || frame_id) AS k FROM c)""", body="""
SELECT frame_id, click, error, 'alone' AS kind FROM (SELECT * FROM o WHERE click > 0 AND error < 1 ORDER BY k LIMIT 40)
UNION ALL SELECT frame_id, click, error, 'paired' FROM (SELECT * FROM o WHERE click > 0 AND click = error ORDER BY k LIMIT 30)
UNION ALL SELECT frame_id, click, error, 'neither' FROM (SELECT * FROM o WHERE click < 1 AND error < 1 ORDER BY k LIMIT 20)"""))
def p13(spark, d):
    c = det(spark, d).groupBy("frame_id").agg(*[F.count_if(F.col("category") == x).alias(x) for x in ("click", "error")])
    return D.label_combinations(c, "click", "error", {"alone": 40, "paired": 30, "neither": 20}, 1, "frame_id")


@query("T1_iou_giou", with_views("det", body=f"""
SELECT a.event_id, round({iou_sql()}, 8) AS iou, round({giou_sql()}, 8) AS giou FROM det a JOIN det b ON b.event_id = a.event_id + 1"""))
def t1(spark, d):
    a = det(spark, d).select("event_id", *B.CORNERS)
    b = det(spark, d).select((F.col("event_id") - 1).alias("event_id"), *[F.col(c).alias("b_" + c) for c in B.CORNERS])
    return a.join(b, "event_id").select("event_id", F.round(B.iou(B.box(), B.box("b_")), 8).alias("iou"),
                                        F.round(B.giou(B.box(), B.box("b_")), 8).alias("giou"))


def nms_sql(src, by, score, limit, key="event_id"):
    join = " AND ".join(f"a.{c} = b.{c}" for c in by)
    cols = ", ".join(by)
    return f"""items AS (SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY {score} DESC, {key}) AS rk FROM {src}),
conf AS (SELECT a.{key} AS {key}, list(b.rk) AS worse_than FROM items a JOIN items b ON {join} AND b.rk < a.rk AND {iou_sql()} > {limit} GROUP BY 1),
prep AS (SELECT i.*, coalesce(worse_than, []) AS worse_than FROM items i LEFT JOIN conf c ON c.{key} = i.{key}),
walk AS (SELECT {cols}, 1::bigint AS rk, [1::bigint] AS kept FROM items WHERE rk = 1
  UNION ALL SELECT {', '.join('p.' + c for c in by)}, p.rk, CASE WHEN list_has_any(w.kept, p.worse_than) THEN w.kept ELSE list_append(w.kept, p.rk) END
  FROM walk w JOIN prep p ON {' AND '.join(f'p.{c} = w.{c}' for c in by)} AND p.rk = w.rk + 1),
verdict AS (SELECT p.*, list_contains(w.kept, p.rk) AS kept FROM prep p JOIN walk w ON {' AND '.join(f'p.{c} = w.{c}' for c in by)} AND w.rk = p.rk)"""


def recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("T2_suppression", recursive(with_views("det", extra=nms_sql("det", ["frame_id"], "confidence", 0.2), body="SELECT event_id, kept FROM verdict")))
def t2(spark, d):
    return D.suppress(det(spark, d), 0.2, by=["frame_id"]).select("event_id", "kept")


def linker_sql(name, rules, by, source="det", confidence="confidence"):
    """Views that end in ``name`` (event_id, tid, suppressed): frame after frame, all ways to match a frame's boxes with the live tracks.

    Stretches between gaps that no track outlives are walked side by side.
    """
    split, gap = ", ".join(by), f">= {rules.grace}" if rules.expire_at_grace else f"> {rules.grace}"
    by = [*by, "seg"]
    keys = ", ".join(by)
    same = " AND ".join(f"f.{k} = w.{k}" for k in by)
    box = "id BIGINT, tid BIGINT, frame BIGINT, conf DOUBLE, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE"
    dead = f"f.frame_id - l.frame {gap}"
    none = 1 << 62
    if rules.suppress_above is None:
        kept, off = "dets", "FALSE"
    else:
        order = f"list_sort(list_transform(range(1, len(dets) + 1), lambda i: {{'s': CASE WHEN k[i] < {none} THEN -1.5 ELSE -dets[i].conf END, 'id': dets[i].id, 'd': dets[i]}}))"
        kept = f"""list_reduce({order}, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: {iou_sql('a.', 'x.d.')} > {rules.suppress_above})) > 0
          THEN acc ELSE list_append(acc, x.d) END, []::STRUCT({box})[])"""
        off = f"k[i] = {none} AND (dets[i].conf <= {rules.start_above} OR NOT list_contains(kept_ids, dets[i].id))"
    return f"""
{name}_rows AS (SELECT *, sum(fresh) OVER (PARTITION BY {split} ORDER BY frame_id)::BIGINT AS seg FROM (
  SELECT *, CASE WHEN frame_id - lag(frame_id) OVER (PARTITION BY {split} ORDER BY frame_id) {gap} THEN 1 ELSE 0 END AS fresh FROM {source})),
{name}_frames AS (SELECT {keys}, frame_id, row_number() OVER (PARTITION BY {keys} ORDER BY frame_id) AS step, dets FROM (
  SELECT {keys}, frame_id, list({{'id': event_id, 'tid': event_id, 'frame': frame_id, 'conf': {confidence}, 'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}} ORDER BY event_id) AS dets
  FROM {name}_rows GROUP BY {keys}, frame_id)),
{name}_walk AS (
  SELECT DISTINCT {keys}, 0::BIGINT AS step, []::STRUCT({box})[] AS live, []::STRUCT(id BIGINT, tid BIGINT, off BOOLEAN)[] AS outs FROM {name}_rows
  UNION ALL
  SELECT {keys}, step, list_concat(list_filter(live, lambda l: NOT list_contains(k, l.tid)),
      list_transform(list_filter(range(1, len(dets) + 1), lambda i: NOT outs[i].off), lambda i: {{'id': dets[i].id, 'tid': outs[i].tid, 'frame': dets[i].frame, 'conf': dets[i].conf,
        'xmin': dets[i].xmin, 'ymin': dets[i].ymin, 'xmax': dets[i].xmax, 'ymax': dets[i].ymax}})) AS live, outs
  FROM (SELECT *, list_transform(range(1, len(dets) + 1), lambda i: {{'id': dets[i].id, 'tid': CASE WHEN k[i] < {none} THEN k[i] ELSE dets[i].id END, 'off': {off}}}) AS outs
    FROM (SELECT *, list_transform({kept}, lambda x: x.id) AS kept_ids
      FROM (SELECT *, list_sort(list_transform(list_reduce(dets, lambda acc, d: flatten(list_transform(acc, lambda p: list_concat(
            [{{'t': p.t, 'k': list_append(p.k, {none})}}],
            list_transform(list_filter(live, lambda l: {iou_sql('d.', 'l.')} >= {rules.iou_min} AND NOT list_contains(p.k, l.tid)), lambda l: {{'t': p.t + {iou_sql('d.', 'l.')}, 'k': list_append(p.k, l.tid)}})))),
          [{{'t': 0::DOUBLE, 'k': []::BIGINT[]}}]), lambda p: {{'t': -round(p.t, 9), 'k': p.k}}))[1].k AS k
        FROM (SELECT {", ".join("f." + x for x in by)}, f.step, f.dets, list_filter(w.live, lambda l: NOT ({dead})) AS live
          FROM {name}_walk w JOIN {name}_frames f ON {same} AND f.step = w.step + 1))))),
{name} AS (SELECT o.id AS event_id, o.tid AS tid, o.off AS suppressed FROM (SELECT unnest(outs) AS o FROM {name}_walk))"""


@query("T3_simple_linker", recursive(with_views("det", extra=linker_sql("simple", K.SIMPLE, ["category"]), body="SELECT * FROM simple")))
def t3(spark, d):
    return K.link_tracks(det(spark, d), K.SIMPLE)


def lively(boxes):
    """Two tracks of three are sure enough to start."""
    return boxes.withColumn("confidence", F.when(F.col("track_id") % 3 == 0, 0.5).otherwise(0.995))


LIVELY = "CASE WHEN track_id % 3 = 0 THEN 0.5 ELSE 0.995 END"


@query("T4_T5_confident_linker", recursive(with_views("det", extra=linker_sql("confident", K.CONFIDENT, ["chunk_id", "category"], confidence=LIVELY), body="SELECT * FROM confident")))
def t4(spark, d):
    return K.link_tracks(lively(det(spark, d)), K.CONFIDENT, partition_by=["chunk_id"])


def near_sql(back, limit):
    return f"""pairs AS (SELECT a.event_id AS new_id, a.frame_id AS new_frame, b.event_id AS old_id, b.frame_id AS old_frame, {iou_sql()} AS iou
  FROM det a JOIN det b ON a.category = b.category AND a.frame_id - b.frame_id BETWEEN 1 AND {back} AND {iou_sql()} >= {limit})"""


@query("J7_near_pairs", with_views("det", extra=near_sql(5, 0.2), body="SELECT new_id, old_id, new_frame, old_frame, round(iou, 8) AS iou FROM pairs"))
def j7(spark, d):
    x = det(spark, d)
    return rounded(D.near_pairs(x, x, ["category"], "event_id", 5, 0.2).drop("category"), "iou", places=8)


def relational_sql():
    return near_sql(30, 0.5) + """,
bo AS (SELECT new_id, arg_max(old_id, (iou, old_frame, -old_id)) AS old_id FROM pairs GROUP BY 1),
bn AS (SELECT old_id, arg_max(new_id, (iou, -new_frame, -new_id)) AS new_id FROM pairs GROUP BY 1),
mutual AS (SELECT bo.new_id, bo.old_id FROM bo JOIN bn ON bo.old_id = bn.old_id AND bo.new_id = bn.new_id),
chain AS (SELECT event_id, event_id AS tid FROM det WHERE event_id NOT IN (SELECT new_id FROM mutual)
  UNION ALL SELECT m.new_id, c.tid FROM chain c JOIN mutual m ON m.old_id = c.event_id)"""


@query("T6_relational_linker", recursive(with_views("det", extra=relational_sql(), body="SELECT event_id, tid FROM chain")))
def t6(spark, d):
    return K.link_relational(det(spark, d), ["category"], "event_id", 30, 0.5)


@query("T7_compare_linkers", recursive(with_views("det", extra=linker_sql("simple", K.SIMPLE, ["category"]) + "," + linker_sql("confident", K.CONFIDENT, ["chunk_id", "category"], confidence=LIVELY) + "," + relational_sql(), body="""
SELECT linker, track_length, count(*) AS freq FROM (
  SELECT 'simple' AS linker, count(*) AS track_length FROM simple GROUP BY tid UNION ALL SELECT 'confident', count(*) FROM confident GROUP BY tid
  UNION ALL SELECT 'relational', count(*) FROM chain GROUP BY tid) GROUP BY ALL""")))
def t7(spark, d):
    x = det(spark, d)
    return K.compare_trackers({"simple": K.link_tracks(x, K.SIMPLE), "confident": K.link_tracks(lively(x), K.CONFIDENT, partition_by=["chunk_id"]),
                               "relational": K.link_relational(x, ["category"], "event_id", 30, 0.5)})


views.define("cells", """SELECT DISTINCT frame_id, category, i, unnest(range(j0, j1)) AS j FROM (
  SELECT frame_id, category, unnest(range(i0, i1)) AS i, j0, j1 FROM (SELECT frame_id, category,
    cast(greatest(floor(ymin/96), 0) AS bigint) AS i0, cast(least(floor((ymax+95)/96), 6) AS bigint) AS i1,
    cast(greatest(floor(xmin/96), 0) AS bigint) AS j0, cast(least(floor((xmax+95)/96), 9) AS bigint) AS j1 FROM det))""", "det")


def cells(spark, d):
    return D.grid_cells(det(spark, d), 96, 864, 576, ["frame_id", "category"])


@query("T8_box_cells", with_views("cells", body="SELECT * FROM cells"))
def t8(spark, d):
    return cells(spark, d)


@query("T9_line_cells", with_views("det", extra="""
s AS (SELECT event_id, xmin AS x1, ymax AS y1, xmax + track_id % 200 AS x2, ymin - track_id % 90 AS y2 FROM det),
r AS (SELECT *, cast(floor(least(x1,x2)/32) AS bigint) AS j0, cast(floor(greatest(x1,x2)/32) AS bigint) AS j1,
  cast(floor(least(y1,y2)/32) AS bigint) AS i0, cast(floor(greatest(y1,y2)/32) AS bigint) AS i1 FROM s),
k AS (SELECT *, range(j0, j1+1) AS js, range(i0, i1+1) AS iss FROM r),
slope AS (SELECT event_id, j0, j1, i0, i1,
  list_sort(list_concat(list_transform(js, lambda j: j*32.0::double), list_transform(iss, lambda i: (i*32.0::double - y2)/(y1-y2)*x1 + (1-(i*32.0::double - y2)/(y1-y2))*x2))) AS px,
  list_sort(list_concat(list_transform(js, lambda j: (j*32.0::double - x2)/(x1-x2)*y1 + (1-(j*32.0::double - x2)/(x1-x2))*y2), list_transform(iss, lambda i: i*32.0::double))) AS py
  FROM k WHERE j0 < j1 AND i0 < i1),
pts AS (SELECT event_id, j0, j1, i0, i1, unnest(px) AS x, unnest(py) AS y FROM slope)""", body="""
SELECT DISTINCT event_id, i, j FROM (
  SELECT event_id, i0, i1, j0, j1, cast(abs(floor(round_even(y/32*100, 0)/100)) AS bigint) AS i, cast(abs(floor(round_even(x/32*100, 0)/100)) AS bigint) AS j FROM pts)
WHERE i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1
UNION SELECT event_id, unnest(iss), j0 FROM k WHERE j0 = j1
UNION SELECT event_id, i0, unnest(js) FROM k WHERE i0 = i1 AND j0 < j1"""))
def t9(spark, d):
    s = det(spark, d).select("event_id", F.col("xmin").alias("x1"), F.col("ymax").alias("y1"),
                             (F.col("xmax") + F.col("track_id") % 200).alias("x2"), (F.col("ymin") - F.col("track_id") % 90).alias("y2"))
    return D.line_cells(s, 32, ["event_id"])


MASKS = "masks AS (SELECT frame_id, i, j, " + ", ".join(f"max(cast(category='{c}' AS int)) AS \"{c}\"" for c in CATEGORIES) + " FROM cells GROUP BY ALL)"


@query("T10_category_masks", with_views("cells", extra=MASKS, body="SELECT * FROM masks"))
def t10(spark, d):
    return D.category_masks(cells(spark, d), "frame_id", CATEGORIES)


@query("T11_composite_mask", with_views("cells", extra=MASKS, body="""
SELECT frame_id, i, j, error, signup, click, greatest(purchase, "view") AS purchase_or_view FROM masks"""))
def t11(spark, d):
    m = D.category_masks(cells(spark, d), "frame_id", CATEGORIES)
    return D.composite_mask(m, "click", ["purchase", "view"], "signup").select("frame_id", "i", "j", "error", "signup", "click", "purchase_or_view")


views.define("codes", """SELECT frame_id, i, j, c.* FROM (SELECT frame_id, cast(floor(cy/64) AS bigint) AS i, cast(floor(cx/64) AS bigint) AS j,
    arg_max({'rel_x': (cx % 64)/64, 'rel_y': (cy % 64)/64, 'rel_w': ln((xmax-xmin)/60), 'rel_h': ln((ymax-ymin)/60)}, event_id) AS c
  FROM (SELECT *, (xmin+xmax)/2 AS cx, (ymin+ymax)/2 AS cy FROM det) GROUP BY ALL)""", "det")


def codes(spark, d):
    return D.encode_boxes(det(spark, d), "frame_id", 64.0, 60.0, 60.0, "event_id")


@query("T12_box_codes", with_views("codes", body="""
SELECT frame_id, i, j, round(rel_x, 8) AS rel_x, round(rel_y, 8) AS rel_y, round(rel_w, 8) AS rel_w, round(rel_h, 8) AS rel_h FROM codes"""))
def t12(spark, d):
    return rounded(codes(spark, d), "rel_x", "rel_y", "rel_w", "rel_h", places=8)


views.define("decoded", """SELECT frame_id, frame_id*10000 + i*100 + j AS box_id, 1/(1+exp(-(rel_x*4 - 1))) AS score,
  (j+rel_x)*64 - exp(least(rel_w,8))*60/2 AS xmin, (i+rel_y)*64 - exp(least(rel_h,8))*60/2 AS ymin,
  (j+rel_x)*64 + exp(least(rel_w,8))*60/2 AS xmax, (i+rel_y)*64 + exp(least(rel_h,8))*60/2 AS ymax FROM codes""", "codes")


def decoded(spark, d):
    c = codes(spark, d).withColumn("box_id", F.col("frame_id") * 10000 + F.col("i") * 100 + F.col("j")).withColumn("score", F.col("rel_x") * 4 - 1)
    return D.decode_boxes(c, 64.0, 60.0, 60.0)


@query("T12_decoded_boxes", with_views("decoded", body="SELECT box_id, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM decoded"))
def t12d(spark, d):
    return rounded(decoded(spark, d).select("box_id", *B.CORNERS), *B.CORNERS)


@query("T13_proposals", recursive(with_views("decoded", extra="passed AS (SELECT * FROM decoded WHERE score > 0.4), " + nms_sql("passed", ["frame_id"], "score", 0.1, "box_id"),
       body="SELECT frame_id, box_id, round(score, 8) AS score FROM verdict WHERE kept")))
def t13(spark, d):
    p = D.proposals(decoded(spark, d), "score", 0.4, 0.1, ["frame_id"], "box_id", logits=True)
    return rounded(p.select("frame_id", "box_id", "score"), "score", places=8)
