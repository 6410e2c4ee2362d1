import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from framesift.functions.ordinal import in_parts
from framesift.session import scratch_path
from framesift.sources import dataset, files


def test_unknown_formats_are_refused(spark):
    with pytest.raises(ValueError):
        dataset.read_data(spark, "/tmp/boxes.xyz")


def test_dumps_are_never_overwritten(spark):
    root = scratch_path(spark, "dumps")
    files.dump_results(spark.range(3), root, "r", 0)
    files.dump_results(spark.range(4), root, "r", 1)
    with pytest.raises(AnalysisException):
        files.dump_results(spark.range(5), root, "r", 0)
    assert spark.read.parquet(root).count() == 7


def test_done_clips_are_skipped(spark):
    out = scratch_path(spark, "clips")
    clips = spark.createDataFrame([("a",), ("b",)], "path string")
    detect = lambda todo: todo.withColumn("n", F.lit(1))
    files.run_missing_clips(clips.where("path = 'a'"), out, detect)
    files.run_missing_clips(clips, out, detect)
    assert sorted(r.path for r in files.clip_boxes(spark, out).collect()) == ["a", "b"]


def test_frames_stay_when_all_labels_are_dropped(spark):
    rows = [("p", 0, 1, "car", 0.9), ("p", 1, 2, "car", 0.1)]
    boxes = spark.createDataFrame(rows, "path string, frame_id long, event_id long, category string, confidence double").withColumns(
        {**{c: F.lit(1.0) for c in ("xmin", "ymin", "xmax", "ymax")}, "height": F.lit(10), "width": F.lit(20), "video_name": F.lit("v")})
    docs = {r.frame_id: len(r.labels) for r in files.nested_labels(boxes, 0.5).collect()}
    assert docs == {0: 1, 1: 0}
    _, images, annotations = files.coco_tables(files.nested_labels(boxes, 0.5), ["bus", "car"])
    assert [r.id for r in images.collect()] == [1]
    assert [(r.id, r.image_id, r.category_id) for r in annotations.collect()] == [(0, 1, 1)]


def test_crowded_keys_are_cut_into_parts(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    sizes = in_parts(rows, ["k"], "id", 100).groupBy("k", "part").count().collect()
    assert sum(r["count"] for r in sizes) == 1000 and len(sizes) == 10 and max(r["count"] for r in sizes) < 200


def test_standard_codes_mark_missing_tracks(spark):
    boxes = spark.createDataFrame([(5, 0, "a"), (None, 1, "a"), (2, 2, "b")], "tid long, f long, c string")
    ds = dataset.Dataset("d", "", track_id="tid", frame_id="f", category="c")
    assert {(r.track_id, r.frame_id) for r in dataset.standardize_boxes(ds, boxes).collect()} == {(1, 0), (-1, 1), (0, 2)}
    assert dataset.video_len(ds, boxes) == 3


def test_images_with_several_documents_are_numbered_once(spark):
    from framesift.sources import files as S
    boxes = spark.createDataFrame([(i, "d/a", 1, "view", 0.9, 0.0, 0.0, 1.0, 2.0, 10, 20, "v") for i in range(6)],
                                  "event_id long, path string, frame_id long, category string, confidence double, xmin double, ymin double, xmax double, ymax double, height int, width int, video_name string")
    docs = S.nested_labels(boxes, 0.5, max_labels=2)
    assert docs.count() > 1
    _, images, annotations = S.coco_tables(docs, ["view"])
    assert images.count() == 1 and sorted(r.id for r in annotations.collect()) == list(range(6))


def test_frames_with_several_label_documents_keep_their_labels_once(spark, tmp_path):
    from framesift.sources import files as S
    label = '{"id": "%s", "category": "car", "box2d": {"x1": 0, "y1": 0, "x2": 1, "y2": 1}}'
    docs = ['{"name": "v-0000001.jpg", "video_name": "v", "index": 1, "labels": [%s]}' % (label % i) for i in "ab"]
    (tmp_path / "x.json").write_text("\n".join(docs))
    boxes, frames = S.read_tracking_labels(spark, str(tmp_path / "x.json"))
    assert sorted((r.id, r.frame_idx) for r in boxes.collect()) == [("a", 0), ("b", 0)] and frames.count() == 1


def test_probe_over_many_lines(spark, tmp_path):
    from framesift.sources import files as S
    (tmp_path / "p.json").write_text('{\n "frames": [\n {"pkt_pos": "4",\n "pkt_size": "5"},\n {"pkt_pos": "6", "pkt_size": "7"}\n ]\n}\n')
    rows = S.read_frame_probe(spark, str(tmp_path / "p.json"), "pkt_pos: string, pkt_size: string").collect()
    assert [(r.pkt_pos, r.pkt_size) for r in rows] == [(4, 5), (6, 7)]
    (tmp_path / "q.json").write_text("{ not a document")
    with pytest.raises(Exception):
        S.read_frame_probe(spark, str(tmp_path / "q.json"), "pkt_pos: string").collect()


def test_an_empty_newest_dump_is_the_latest(spark, tmp_path):
    from framesift.sources import files as S
    root = str(tmp_path / "dumps")
    spark.range(3).write.parquet(f"{root}/2024-01-01/grader9.parquet")
    spark.range(0).write.parquet(f"{root}/2024-01-02/grader1.parquet")
    assert S.latest_dump(spark, root).count() == 0 and S.latest_dump(spark, root, "2024-01-01").count() == 3
    with pytest.raises(FileNotFoundError):
        S.latest_dump(spark, root, "1999-01-01")


def test_a_clip_without_boxes_is_run_once(spark, tmp_path):
    from framesift.sources import files as S
    out, runs = str(tmp_path / "clips"), []

    def detect(todo):
        runs.append(sorted(r.path for r in todo.collect()))
        return todo.where("path = 'a'").selectExpr("path", "1 AS box")

    clips = spark.createDataFrame([("a",), ("b",)], "path string")
    S.run_missing_clips(clips, out, detect)
    S.run_missing_clips(clips.union(spark.createDataFrame([("c",)], "path string")), out, detect)
    assert runs == [["a", "b"], ["c"]] and S.clip_boxes(spark, out).count() == 1
