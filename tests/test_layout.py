"""The layout operators on small vectors with known answers."""

import math
import time

import numpy as np
import pytest
from compare import TABLES, difference
from pagewright.functions import geometry as G
from pagewright.functions import taxonomy
from pagewright.functions.text import bullets, inline, normalize_latex
from pagewright.operators import correction, decode, export, guards, tables
from pagewright.operators.order import banded_ranks, xy_cut
from pagewright.plans import catalog
from pagewright.schema import TABLE, AnalysisOptions, CustomModel, InvalidOptionError, ServiceOptions
from pagewright.sources import derived
from pyspark.sql import functions as F


def cut(items, tolerance=0.0):
    names = list(items)
    return " ".join(names[i] for i in xy_cut([(x, y, x + w, y + h) for x, y, w, h in items.values()], tolerance))


@pytest.mark.parametrize(
    "items, tolerance, expected",
    [
        ({"c": (0, 200, 100, 40), "a": (0, 0, 100, 40), "b": (0, 100, 100, 40)}, 0, "a b c"),
        ({"R1": (200, 0, 100, 40), "L2": (0, 100, 100, 40), "R2": (200, 100, 100, 40), "L1": (0, 0, 100, 40)}, 0, "L1 L2 R1 R2"),
        ({"L1": (0, 100, 100, 40), "R1": (200, 100, 100, 40), "H": (0, 0, 300, 40), "L2": (0, 160, 100, 40), "R2": (200, 160, 100, 40)}, 0, "H L1 L2 R1 R2"),
        ({"A": (0, 0, 100, 20), "B": (110, 0, 100, 20), "C": (0, 120, 100, 20), "D": (110, 120, 100, 20)}, 0, "A B C D"),
        ({"A": (0, 0, 100, 20), "B": (300, 0, 100, 20), "C": (0, 40, 100, 20), "D": (300, 40, 100, 20)}, 0, "A C B D"),
        ({"L1": (0, 0, 100, 40), "L2": (0, 50, 100, 40), "L3": (0, 100, 100, 40), "R1": (97, 0, 100, 70), "R2": (97, 80, 100, 40)}, 0, "L1 R1 L2 R2 L3"),
        ({"L1": (0, 0, 100, 40), "L2": (0, 50, 100, 40), "L3": (0, 100, 100, 40), "R1": (97, 0, 100, 70), "R2": (97, 80, 100, 40)}, 5, "L1 L2 L3 R1 R2"),
        ({"A": (0, 0, 90, 10), "B": (200, 0, 300, 15), "C": (40, 120, 164, 10), "D": (498, 100, 20, 100)}, 5, "A B C D"),
        ({"Caption": (10, 370, 200, 20), "Figure": (0, 0, 400, 400)}, 0, "Figure Caption"),
    ],
)
def test_xy_cut(items, tolerance, expected):
    assert cut(items, tolerance) == expected


def test_tall_columns_need_no_deep_recursion():
    assert xy_cut([(0, 10 * k, 5, 10 * k + 5) for k in reversed(range(3000))]) == list(reversed(range(3000)))


def test_bands_and_hints():
    boxes = [[0, 0, 10, 10], [0, 20, 10, 30], [0, 40, 10, 50]]
    assert banded_ranks(boxes, [2, 1, 0], None, 0) == [2, 1, 0]
    assert banded_ranks(boxes, [1, 1, 1], [30, 20, 10], 0) == [2, 1, 0]


def test_boxes(spark):
    row = spark.range(1).select(*(F.lit(float(x)).alias(c) for c, x in zip(("x1", "y1", "x2", "y2"), (0, 0, 10, 10), strict=True)), *(F.lit(float(x)).alias("b" + c) for c, x in zip(("x1", "y1", "x2", "y2"), (5, 0, 15, 10), strict=True)))
    a, b = G.Box.named(), G.Box.named("b")
    line = G.Box(G.d(3), G.d(3), G.d(3), G.d(9))
    out = row.select(a.iou(b).alias("iou"), a.iou(a).alias("same"), line.is_empty.alias("line_empty"), F.array(*G.Box(G.d(-5), G.d(2.5), G.d(50), G.d(3.5)).pixel_rect(F.lit(40), F.lit(40))).alias("rect")).first()
    assert out.iou == pytest.approx(1 / 3) and out.same == 1 and not out.line_empty and out.rect == [0, 2, 40, 2]


def test_source_points(spark):
    point = lambda rotation, skew, sw, sh, w, h, x, y: list(spark.range(1).select(*G.to_source(G.d(x), G.d(y), F.lit(rotation), G.d(skew), F.lit(sw), F.lit(sh), F.lit(w), F.lit(h))).first())
    assert point(0, 0, 0, 0, 400, 600, 7, 8) == [7, 8]
    assert point(90, 0, 0, 0, 400, 600, 0, 0) == [400, 0]
    assert point(90, 4, 500, 700, 740, 540, 370, 270) == pytest.approx([250, 350])


def test_paddle_rows(spark):
    frame = lambda rows, w=800, h=800: spark.createDataFrame([([float(x) for r in rows for x in r], w, h)], "rows array<float>, width int, height int")
    got = decode.decode_paddle(frame([[9, 0.9, 100, 200, 300, 400]], 1600, 400), 0.5, 800).first()
    assert (got.x1, got.y1, got.x2, got.y2, got.class_id) == (200, 100, 600, 200, 9) and got.score == pytest.approx(0.9)
    kept = decode.decode_paddle(frame([[8, 0.95, 0, 0, 9, 9], [2, 0.1, 0, 0, 9, 9], [-1, 0.99, 0, 0, 9, 9], [3, math.nan, 0, 0, 9, 9]]), 0.5, 800)
    assert [r.class_id for r in kept.collect()] == [8]
    edges = decode.decode_paddle(frame([[0, 0.9, -50, -50, 100, 100], [0, 0.9, 790, 10, 900, 20], [0, 0.9, 10, 10, 10.2, 10.3]]), 0.5, 800).collect()
    assert [(r.x1, r.x2) for r in edges] == [(0, 100), (790, 800)]
    counted = frame([[0, 0.9, 0, 0, 9, 9], [1, 0.9, 0, 0, 9, 9]]).withColumn("n", F.explode(F.array(F.lit(5), F.lit(1), F.lit(0))))
    assert [decode.decode_paddle(counted.filter(f"n = {n}"), 0.5, 800, count="n").count() for n in (5, 1, 0)] == [2, 1, 2]


def test_letterbox_and_yolo(spark):
    box = lambda w, h: spark.range(1).select(*(c.alias(n) for n, c in G.letterbox(F.lit(w), F.lit(h), 640).items())).first().asDict()
    assert box(2816, 1536) == {"scale": 640 / 2816, "content_width": 640, "content_height": 349, "pad_x": 0, "pad_y": 145.5, "left": 0, "top": 145}
    assert box(320, 320)["scale"] == 2
    rows = spark.createDataFrame([([float(x) for x in (64, 224, 320, 352, 0.9, 1, 0, 0, 0, 0, 0, 0, 1, 1, 99, 99, 0.2, 1, 1, 1, 99, 99, 0.9, -1)], 1000, 400)], "rows array<float>, width int, height int")
    got = decode.decode_yolo(rows, 0.5, 640).collect()
    assert [(r.x1, r.y1, r.x2, r.y2) for r in got] == [(100, 50, 500, 250)]


def test_orientation(spark):
    run = lambda v: spark.createDataFrame([(v,)], "v array<float>").select(decode.decode_orientation(F.col("v")).alias("p")).first().p
    assert run([0.92, 0.03, 0.02, 0.03]).rotation == 0 and run([0.92, 0.03, 0.02, 0.03]).confidence == pytest.approx(0.92)
    got = run([1.0, 4.0, 2.0, 0.0])
    assert got.rotation == 90 and 0.75 < got.confidence < 0.85
    with pytest.raises(Exception, match="4 values"):
        run([1.0, 2.0])


def test_orientation_equals_its_sql_on_odd_vectors(spark, sf_dir, tmp_path):
    for name in TABLES:
        if name != "embeddings":
            (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    # A softmax of 0.205 - 4e-9 that 32 bits round up, 28.5 hundredths as a product, only zeros, NaN, and too few values.
    near = [-0.1538633108139038, 0.026526043191552162, 0.3075689673423767, -0.17840635776519775]
    vectors = [near, [57.0, 43.0, 60.0, 40.0], [0.0] * 4, [float("nan"), 1.0, 2.0, 0.5], [1.0, 2.0, 3.0], [], None, near * 3 + [1.0]]
    rows = [(3 * i + phase, v) for i, v in enumerate(vectors) for phase in range(3)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert difference(catalog.QUERIES["orientation_decode"](spark, str(tmp_path)), catalog.ORACLE_SQL["orientation_decode"], str(tmp_path)) is None


def grid_of(table):
    return [[next((c["text"] or "" for c in table["cells"] if c["row"] <= r < c["row"] + c["row_span"] and c["column"] <= k < c["column"] + c["column_span"]), "") for k in range(table["column_count"])] for r in range(table["row_count"])]


def test_html_tables():
    t = tables.table_from_html('<table><tr><td rowspan="2">A</td><td>B</td></tr><tr><td>C</td></tr><tr><td colspan="2">E</td></tr></table>')
    assert grid_of(t) == [["A", "B"], ["A", "C"], ["E", "E"]]
    t = tables.table_from_html("<HTML><body><TABLE><TR><TD>a &amp; b<br>c</TD><td>&nbsp;x&#33;<TR><td>&lt;y&gt;</table><table><tr><td>second</table>")
    assert [c["text"] for c in t["cells"]] == ["a & b c", "x!", "<y>"] and (t["row_count"], t["column_count"]) == (2, 2)
    assert tables.table_from_html('<td><b>bold</b> <span title="a > b">t</span></td>')["cells"][0]["text"] == "bold t"
    assert all(tables.table_from_html(x) is None for x in (None, "", "  ", "<p>x</p>", "<table></table>", "<table><tr></tr></table>"))
    wide = tables.table_from_html("<td colspan=\"1000000\" rowspan='99999'>x")
    assert (wide["column_count"], wide["row_count"], wide["cells"][0]["row_span"]) == (512, 1, 1)
    spans = [tables.read_span(x, "colspan") for x in (" colspan=2", " colspan=abc", ' colspan="0"', " data-colspan=3", " colspan=99999999999")]
    assert spans == [2, 1, 1, 3, 1]
    assert tables.table_from_html("<table><tr><td>a <b")["cells"][0]["text"] == "a <b"


def test_table_exports(spark):
    cells = [(0, 0, 1, 2, False, 'say "hi"'), (1, 0, 1, 1, False, "plain"), (1, 1, 1, 1, False, "has,comma")]
    row = spark.createDataFrame([((2, 2, [(*c, None) for c in cells], None),), ((1, 2, [(0, 0, 1, 1, True, "a|b", None), (0, 1, 1, 1, True, None, None)], None),), ((0, 0, [], None),)], f"t {TABLE}")
    out = row.select(tables.to_csv(F.col("t")).alias("csv"), tables.to_markdown(F.col("t")).alias("md"), tables.to_html(F.col("t")).alias("html")).collect()
    assert out[0].csv == '"say ""hi""","say ""hi"""\r\nplain,"has,comma"\r\n' and out[0].md == out[0].html
    assert out[1].md == "| a\\|b |  |\n| --- | --- |" and out[2].html == "<table>\n</table>" and out[2].md == ""


def test_texts(spark):
    frame = spark.createDataFrame([(x,) for x in (None, "", "   ", "$$", "E=mc^2", "  $E=mc^2$ ", "$$ E=mc^2 $$", "\\[a\\]", "\\(a\\)", "$")], "x string")
    assert [r[0] for r in frame.select(normalize_latex(F.col("x"))).collect()] == [None, None, None, None, "E=mc^2", "E=mc^2", "E=mc^2", "a", "a", "$"]
    one = spark.createDataFrame([("• first\r\n  • second\n---",)], "x string").select(bullets(F.col("x")).alias("b"), inline(F.col("x")).alias("i")).first()
    assert one.b == "- first\n- second\n- ---" and one.i == "• first • second ---"


def bare_latex(text):
    text = text.strip()
    for before, after in (("$$", "$$"), ("$", "$"), ("\\[", "\\]"), ("\\(", "\\)")):
        if text.startswith(before) and text.endswith(after) and len(text) >= len(before + after):
            return text[len(before) : -len(after)].strip() or None
    return text or None


def test_latex_of_whole_texts(spark, sf_dir, tmp_path):
    odd = ["a b", " x  y ", "one\n two \n\nthree\n", "a $", "$ a", "$a b$", "\\[a b\\]", "\\(a\\) b\\)", "é\u3000𝑥 \n", "  ", "$$ $$", "x " * 3000 + "end"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(7_000_000 + 7 * i + k, x) for i, x in enumerate(odd) for k in range(7)], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [("$$ ", " $$"), ("  $", "$ "), ("\\[", "\\]"), ("\\(", "\\)"), ("", ""), ("", ""), ("", "")]
    want = {r.doc_id: bare_latex(pairs[r.doc_id % 7][0] + r.text + pairs[r.doc_id % 7][1]) for r in docs.collect()}
    assert {r.doc_id: r.latex for r in catalog.QUERIES["latex_normalize"](spark, str(tmp_path)).collect()} == want


def test_labels_cross_every_language(spark, tmp_path):
    spark.createDataFrame([("fr",), ("fr",), ("de",)], "lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.QUERIES["type_map_builtin"](spark, str(tmp_path)).collect()
    labels = {(r.model, r.label) for r in rows}
    assert len(labels) > 40 and sorted((r.model, r.label, r.lang, r.n_docs) for r in rows) == sorted((*x, lang, n) for x in labels for lang, n in (("fr", 2), ("de", 1)))
    assert len({(r.label, r.type, r.text_bearing, r.furniture) for r in rows}) == len({x[1] for x in labels})


def test_document_exports(spark):
    rows = [(1, 1, 0, "PageHeader", "Head"), (1, 1, 1, "Title", "Quarterly\nReport"), (1, 1, 2, "Figure", None), (1, 1, 3, "List", "• a\n• b"), (1, 2, 0, "PageNumber", "7"), (1, 2, 1, "Formula", None), (2, 1, 0, "Seal", " ")]
    blocks = spark.createDataFrame(rows, "doc_id long, page_number int, reading_order int, type string, text string")
    text = {r.doc_id: r.text for r in export.document_text(blocks, export.plain_payload(F.col("text"))).collect()}
    assert text == {1: "Head\nQuarterly\nReport\n• a\n• b\n\n7", 2: ""}
    md = {r.doc_id: r.markdown for r in export.document_markdown(blocks, export.block_markdown(F.col("type"), F.col("text"))).collect()}
    assert md[1] == "# Quarterly Report\n\n*[Figure]*\n\n- a\n- b\n\n---\n\n*[Formula]*"


def test_options():
    for bad in ({"confidence_threshold": math.nan}, {"deskew_max_angle": 0}, {"reading_order_overlap_tolerance": -1}, {"page_parallelism": 0}, {"reading_order_source": "x"}):
        with pytest.raises(InvalidOptionError):
            AnalysisOptions(**bad)
    model = CustomModel("m.onnx", 640, ["a"], "yolo")
    assert ServiceOptions(custom_model=model).model == "custom" and ServiceOptions().model == "v3"
    with pytest.raises(InvalidOptionError):
        ServiceOptions(model="v3", custom_model=model)
    with pytest.raises(InvalidOptionError):
        CustomModel("m.onnx", 100, ["a"], "yolo")


def test_guards_can_fail_the_job(spark):
    pages = spark.createDataFrame([(1, 10, 10), (2, 50_000, 50_000)], "id int, width int, height int")
    error = guards.too_large(F.col("width"), F.col("height"), 1_000_000)
    assert [r.e is None for r in pages.select(error.alias("e")).collect()] == [True, False]
    with pytest.raises(Exception, match="2500000000 pixels"):
        guards.enforce(pages, error).collect()


@pytest.mark.parametrize("angle", [3.0, -7.5, 12.0])
def test_skew(angle):
    found, _, reliable = correction.estimate_skew(correction.draw_page(5, angle, 1000, 1400))
    assert reliable and abs(found - angle) <= 0.5


def test_skew_of_every_page(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("floor(l_orderkey / 4) % 12 = 7")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    pages = {r[0] for r in lines.selectExpr("floor(l_orderkey / 4)").distinct().collect()}
    rows = catalog.QUERIES["page_skew"](spark, str(tmp_path)).collect()
    assert max(pages) > 12 and sorted(r.page_id for r in rows) == sorted(pages)
    assert all(r.within and r.drawn == (r.page_id % 5 - 2) * 3 for r in rows)


def test_many_pages_are_drawn_and_estimated_in_bounded_time():
    began = time.process_time()
    found = correction.estimate_skews([correction.draw_page(k, 6.0)[..., 0] for k in range(100)])
    assert time.process_time() - began < 6  # 14 s when pages were drawn tap by tap and searched one by one
    assert all(reliable and abs(angle - 6) <= 0.5 for angle, _, reliable in found)


@pytest.mark.parametrize("skew, width, height", [(3.0, 500, 700), (-6.0, 500, 700), (45.0, 300, 400), (-33.3, 411, 523), (90.0, 300, 400), (7.0, 300, 90)])
def test_drawn_pages_are_turned_like_any_image(skew, width, height):
    straight = correction.draw_page(8, 0.0, width, height)
    assert (correction.draw_page(8, skew, width, height) == correction.rotate(straight, skew)).all()


def test_skews_together_equal_skews_apart():
    pages = [correction.draw_gray(k, s, 300, 400) for s in (-4.0, 0.0, 2.5) for k in range(19)]
    pages += [np.full((300, 400), 255, np.uint8), correction.draw_page(1, 9.0, 1000, 1300), correction.draw_gray(2, -4.0, 300, 401)]
    noise = np.random.default_rng(1).integers(0, 256, (9, 700, 800), np.uint8)  # more ink than is kept
    pages += [*noise, *np.where(noise[:, :300, :400] < 9, 255, 20).astype(np.uint8)]
    for most in (15.0, 45.0):
        apart = [correction.estimate_skew(p, most) for p in pages]
        assert correction.estimate_skews(pages, most) == apart
    gray = pages[0][::2, 1::3]
    assert correction.otsu_threshold(gray) == correction.otsu_threshold(np.repeat(gray, 2, axis=0)) and correction.ink(pages[0])[0].shape[1] == (pages[0] < correction.otsu_threshold(pages[0])).sum()


def _in_tiles(pages):
    of = np.arange(pages[0].size).reshape(-1, 16)
    return of, np.stack([p.T.reshape(-1, 16) for p in pages])


def test_alike_pages_are_estimated_as_apart():
    for skew in (6.0, 0.0, -3.0):
        seeds = list(range(40))
        apart = [correction.estimate_skew(correction.draw_gray(k, skew)) for k in seeds]
        assert correction.estimate_seeds(seeds, skew) == apart == correction.estimate_seeds(seeds, skew)
    noise = np.random.default_rng(2).integers(0, 256, (5, 700, 800), np.uint8)  # more ink than is kept
    blank, black = np.full((700, 800), 255, np.uint8), np.zeros((700, 800), np.uint8)
    black[0, 0] = 255
    known = {}
    for page in (blank, *noise, black):
        some = [page, np.roll(page, 5, axis=0), blank]
        assert correction.estimate_alike(*_in_tiles(some), 800, 700, known) == [correction.estimate_skew(p) for p in some]
    for k in range(12):  # layouts that are not alike
        page = blank.copy()
        page[40 * k : 40 * k + 30, 60 * k : 60 * k + 50] = 0
        assert correction.estimate_alike(*_in_tiles([page]), 800, 700, known) == [correction.estimate_skew(page)]


def test_drawn_pages_take_less_time_than_images():
    def least(run):
        times = []
        for _ in range(4):
            began = time.process_time()
            run()
            times.append(time.process_time() - began)
        return min(times)

    seeds = list(range(32))
    assert least(lambda: correction.estimate_seeds(seeds, 6.0)) < 0.6 * least(lambda: correction.estimate_skews([correction.draw_gray(k, 6.0) for k in seeds]))


def test_correction_of_pixels():
    page = correction.draw_page(1, 0)
    turned = correction.upright(page, 270)
    assert (correction.upright(turned, 90) == page).all()
    same, rotation, skew = correction.correct_page(page, rotation=90, rotation_confidence=0.5)
    assert (same == page).all() and rotation == 0 and skew == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from pagewright.streaming.analyze import analyze_pages

    dets = derived.detections(spark, sf_dir)
    item = F.struct(F.struct(*derived.DET_KEY).alias("pos"), "class_id", "score", "order_hint", "x1", "y1", "x2", "y2")
    pages = dets.groupBy("page_id").agg(F.collect_list(item).alias("dets"))
    pages.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in"))
    out = analyze_pages(stream, taxonomy.VOCABULARIES["heron"], G.d(762), G.d(1000))
    out.select("page_id", "strategy", F.explode(F.arrays_zip("dets", "ranks")).alias("b")).selectExpr("page_id", "strategy", "b.dets.pos.*", "b.ranks AS reading_order").writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    batch = catalog.QUERIES["analyze_blocks"](spark, sf_dir).select("page_id", "strategy", *derived.DET_KEY, "reading_order")
    assert sorted(map(tuple, spark.table("streamed").collect())) == sorted(map(tuple, batch.collect()))


def test_invariants(spark, sf_dir):
    blocks = catalog.QUERIES["analyze_blocks"](spark, sf_dir)
    per = blocks.groupBy("page_id").agg(F.count("*").alias("n"), F.max("reading_order").alias("last"), F.countDistinct("reading_order").alias("d"))
    assert per.filter("last <> n - 1 OR d <> n").count() == 0
    assert blocks.filter("score < 0.5 OR x1 < 0 OR x2 > 762 OR y1 < 0 OR y2 > 1000").count() == 0
