"""DuckDB SQL for the layout queries, written from their definitions and not from the Spark code."""

from __future__ import annotations

from ..functions.taxonomy import CUSTOM_LABELS as _SPELLINGS
from ..functions.taxonomy import FURNITURE, LABELS, TEXT_BEARING, VOCABULARIES
from ..sources import derived

#: Labels of custom models, for the mapping query, and a user's map.
CUSTOM_LABELS = ["Title", "Section-header", "Plain Text", "list_item", "table", "Picture", " running head ", "weird_thing", "seal", "isolate_formula", "Page-Number", "  ", "key value", "TABLE_FOOTNOTE", "check-box", "photo"]
CUSTOM_MAP = {"table": "Figure", "weird_thing": "List"}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _strings(xs) -> str:
    return "(" + ", ".join(map(_text, xs)) + ")"


def _case(column: str, table: dict[str, str], other: str) -> str:
    arms = " ".join(f"WHEN {column} IN {_strings(labels.split())} THEN {_text(kind)}" for kind, labels in table.items())
    return f"CASE {arms} ELSE {other} END"


_HERON = ", ".join(f"({i}, {_text(x)})" for i, x in enumerate(VOCABULARIES["heron"]))
_KEY = ", ".join(derived.DET_KEY)
_TYPE = _case("raw_name", LABELS, "'Other'")
_BASE = f"WITH RECURSIVE det_base AS ({derived.DET_BASE}), dets AS ({derived.DETS}), heron(class_id, raw_name) AS (VALUES {_HERON})"
_STRONG = f"{_BASE}, strong AS (SELECT dets.*, coalesce(raw_name, 'class_' || class_id) AS raw_name, {_TYPE} AS type FROM dets LEFT JOIN heron USING (class_id) WHERE score >= CAST(0.5 AS FLOAT))"


def _width(b: str) -> str:
    return f"greatest(0.0::DOUBLE, {b}x2 - {b}x1)"


def _height(b: str) -> str:
    return f"greatest(0.0::DOUBLE, {b}y2 - {b}y1)"


def _area(b: str) -> str:
    return f"({_width(b)} * {_height(b)})"


def _shared(a: str, b: str) -> str:
    return f"(greatest(0.0::DOUBLE, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0::DOUBLE, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"


def _iou(a: str, b: str) -> str:
    union = f"({_area(a)} + {_area(b)} - {_shared(a, b)})"
    return f"(CASE WHEN {union} <= 0 THEN 0 ELSE {_shared(a, b)} / {union} END)"


_IOU_LIMIT = "CAST(CAST(0.6 AS FLOAT) AS DOUBLE)"
_FIELDS = f"{_KEY}, class_id, raw_name, type, score, order_hint, x1, y1, x2, y2"
_PACK = "struct_pack(" + ", ".join(f"{c} := {c}" for c in _FIELDS.split(", ")) + ")"


def _fold(items: str, drops: str) -> str:
    return f"list_reduce(list_transform({items}, lambda x: [x]), lambda acc, d: CASE WHEN len(list_filter(acc, lambda k: {drops})) > 0 THEN acc ELSE list_concat(acc, d) END)"


def _kept(figure: float | None) -> str:
    """CTEs up to ``kept``: page_id, rank and the fields, after suppression and, with a figure limit, clean-up."""
    out = f"{_STRONG}, arrays AS (SELECT page_id, list({_PACK} ORDER BY score DESC, {_KEY}, x1, y1, x2, y2) AS a FROM strong GROUP BY page_id), deduped AS (SELECT page_id, {_fold('a', f'{_iou("k.", "d[1].")} > {_IOU_LIMIT}')} AS a FROM arrays)"
    if figure is not None:
        nested = f"k.type = d[1].type AND {_area('d[1].')} > 0 AND {_shared('d[1].', 'k.')} / {_area('d[1].')} >= 0.9"
        out += f", figured AS (SELECT page_id, list_filter(a, lambda x: x.type <> 'Figure' OR {_area('x.')} >= {figure} * 762 * 1000) AS a FROM deduped), cleaned AS (SELECT page_id, {_fold('a', nested)} AS a FROM figured WHERE len(a) > 0)"
    last = "deduped" if figure is None else "cleaned"
    return out + f", kept AS (SELECT page_id, i - 1 AS rank, unnest(a[i:i], recursive := true) FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM {last}))"


_BAND = "CASE WHEN type = 'PageHeader' THEN 0 WHEN type IN ('PageFooter', 'PageNumber') THEN 2 ELSE 1 END"


def _cut(group: str, tolerance: float) -> str:
    """CTEs that order ``items`` (group, rank, box) by XY-cut: ``placed`` has path per item."""
    w = f"PARTITION BY {group}, path"
    return f""", rec AS (
  SELECT {group}, rank, x1, y1, x2, y2, CAST([] AS INT[]) AS path, FALSE AS done FROM items
  UNION ALL
  SELECT {group}, rank, x1, y1, x2, y2,
         CASE WHEN n = 1 THEN path
              WHEN nx > 0 AND (ny = 0 OR wx >= wy) THEN list_append(path, CAST(colno AS INT))
              WHEN ny > 0 THEN list_append(path, CASE WHEN bandno = 0 THEN 0 ELSE 1 END)
              ELSE list_append(path, CAST(place AS INT)) END,
         n = 1 OR (nx = 0 AND ny = 0)
  FROM (
    SELECT *, count(*) OVER ({w}) AS n, sum(CAST(cx AS INT)) OVER ({w}) AS nx, sum(CAST(cy AS INT)) OVER ({w}) AS ny,
           max(CASE WHEN cx THEN gx END) OVER ({w}) AS wx, max(CASE WHEN cy THEN gy END) OVER ({w}) AS wy,
           sum(CAST(cx AS INT)) OVER ({w} ORDER BY x1, x2, rank ROWS UNBOUNDED PRECEDING) AS colno,
           sum(CAST(cy AS INT)) OVER ({w} ORDER BY y1, y2, rank ROWS UNBOUNDED PRECEDING) AS bandno,
           row_number() OVER ({w} ORDER BY y1, x1, rank) AS place
    FROM (
      SELECT *, coalesce(gx > -{tolerance}, FALSE) AS cx, coalesce(gy > -{tolerance}, FALSE) AS cy
      FROM (
        SELECT *, x1 - max(x2) OVER ({w} ORDER BY x1, x2, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gx,
               y1 - max(y2) OVER ({w} ORDER BY y1, y2, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gy
        FROM rec WHERE NOT done))))
, placed AS (SELECT * FROM rec WHERE done)"""


_ANALYZED = (
    _kept(0.001)
    + ", choice AS (SELECT page_id, CASE WHEN bool_and(order_hint >= 0) THEN 'model' ELSE 'xycut' END AS strategy FROM kept GROUP BY page_id)"
    + f", banded AS (SELECT kept.*, strategy, {_BAND} AS band FROM kept JOIN choice USING (page_id)), items AS (SELECT page_id, band, rank, x1, y1, x2, y2 FROM banded WHERE strategy = 'xycut')"
    + _cut("page_id, band", 5.0)
    + ", analyzed AS (SELECT banded.*, CAST(row_number() OVER (PARTITION BY banded.page_id ORDER BY banded.band, path, order_hint, banded.rank) - 1 AS INT) AS reading_order FROM banded LEFT JOIN placed ON banded.page_id = placed.page_id AND banded.rank = placed.rank)"
)

_TABLES = f"WITH table_lines AS ({derived.TABLE_LINES}), cells AS ({derived.CELLS})"
_GRID = f"{_TABLES}, grid AS (SELECT ok, CAST(r + dr AS INT) AS \"row\", c AS \"column\", txt AS text FROM (SELECT *, unnest(range(0, rowspan)) AS dr FROM cells))"
_ESCAPED = "replace(replace(replace(txt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _html(cells: str) -> str:
    cell = f"CASE WHEN is_header THEN '<th' ELSE '<td' END || CASE WHEN rowspan > 1 THEN ' rowspan=\"' || rowspan || '\"' ELSE '' END || '>' || {_ESCAPED} || CASE WHEN is_header THEN '</th>' ELSE '</td>' END"
    return f"SELECT ok, '<table>' || chr(10) || string_agg(line, '' ORDER BY r) || '</table>' AS html, bool_or(spans) AS has_spans FROM (SELECT ok, r, '<tr>' || string_agg({cell}, '' ORDER BY c) || '</tr>' || chr(10) AS line, bool_or(rowspan > 1) AS spans FROM {cells} GROUP BY ok, r) GROUP BY ok"


def _csv(delimiter: str) -> str:
    return f"CASE WHEN contains(text, {delimiter}) OR contains(text, '\"') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END"


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CORRECTED = f"WITH pages AS (SELECT *, CASE WHEN page_id % 5 <> 0 THEN width ELSE 0 END AS source_w, CASE WHEN page_id % 5 <> 0 THEN height ELSE 0 END AS source_h FROM ({derived.PAGES})), sized AS (SELECT *, CAST(CASE WHEN source_w > 0 THEN source_w ELSE width END AS DOUBLE) AS sw, CAST(CASE WHEN source_h > 0 THEN source_h ELSE height END AS DOUBLE) AS sh FROM pages), upright AS (SELECT *, CASE WHEN rotation IN (90, 270) THEN sh ELSE sw END AS uw, CASE WHEN rotation IN (90, 270) THEN sw ELSE sh END AS uh FROM sized)"


def _source(x: str, y: str) -> tuple[str, str]:
    ux = f"(CASE WHEN skew = 0 THEN {x} ELSE cos(radians(skew)) * ({x} - width / 2.0::DOUBLE) - sin(radians(skew)) * ({y} - height / 2.0::DOUBLE) + uw / 2 END)"
    uy = f"(CASE WHEN skew = 0 THEN {y} ELSE sin(radians(skew)) * ({x} - width / 2.0::DOUBLE) + cos(radians(skew)) * ({y} - height / 2.0::DOUBLE) + uh / 2 END)"
    return f"(CASE rotation WHEN 90 THEN sw - {uy} WHEN 180 THEN sw - {ux} WHEN 270 THEN {uy} ELSE {ux} END)", f"(CASE rotation WHEN 90 THEN {ux} WHEN 180 THEN sh - {uy} WHEN 270 THEN sh - {ux} ELSE {uy} END)"


_CORNERS = [_source(x, y) for x in ("x1", "x2") for y in ("y1", "y2")]
_GRAY = "WITH gray AS (SELECT event_type, event_id, CAST((299 * r + 587 * g + 114 * b + 500) // 1000 AS INT) AS luma FROM (SELECT event_type, event_id, CAST(((CAST(floor(value * 100) AS BIGINT) % 256) + 256) % 256 AS INT) AS r, CAST(user_id % 256 AS INT) AS g, CAST(event_id % 256 AS INT) AS b FROM events))"


def _packed(factor: float) -> str:
    """Detections as a decoder sees them: 32-bit values in input space, numbered per page."""
    return f"{_BASE}, pages AS ({derived.PAGES}), packed AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {_KEY}, class_id, score, x1, y1, x2, y2) - 1 AS INT) AS det_pos, class_id, score, order_hint, CAST(CAST(x1 * {factor} AS FLOAT) AS DOUBLE) AS fx1, CAST(CAST(y1 * {factor} AS FLOAT) AS DOUBLE) AS fy1, CAST(CAST(x2 * {factor} AS FLOAT) AS DOUBLE) AS fx2, CAST(CAST(y2 * {factor} AS FLOAT) AS DOUBLE) AS fy2 FROM dets)"


def _clamped(expression: str, most: str) -> str:
    return f"greatest(0.0::DOUBLE, least({expression}, CAST({most} AS DOUBLE)))"


def _decoded(x: str, y: str, hint: str, factor: float, extra: str = "") -> str:
    box = ", ".join(f"{_clamped((x if c[0] == 'x' else y).format('f' + c), 'width' if c[0] == 'x' else 'height')} AS {c}" for c in ("x1", "y1", "x2", "y2"))
    return f"{_packed(factor)}, lb AS (SELECT page_id, width, height{extra} FROM pages), boxes AS (SELECT page_id, det_pos, class_id, score, {hint} AS order_hint, {box} FROM packed JOIN lb USING (page_id) WHERE score >= CAST(0.5 AS FLOAT)) SELECT page_id, det_pos, class_id, score, CAST(order_hint AS INT) AS order_hint, round(x1, 3) AS x1, round(y1, 3) AS y1, round(x2, 3) AS x2, round(y2, 3) AS y2 FROM boxes WHERE x2 - x1 >= 1 AND y2 - y1 >= 1"


_SCALE = "least(640 / CAST(width AS DOUBLE), 640 / CAST(height AS DOUBLE))"
_CONTENT = {s: f"greatest(1, least(640, CAST(round_even({s} * {_SCALE}, 0) AS INT)))" for s in ("width", "height")}
_PAD = {s: f"((640 - {_CONTENT[s]}) / CAST(2 AS DOUBLE))" for s in _CONTENT}
_PLACE = {s: f"greatest(0, CAST(round({_PAD[s]} - 0.1::DOUBLE) AS INT))" for s in _CONTENT}

_LINES = f"WITH lines AS (SELECT doc_id, CAST(i // 25 + 1 AS INT) AS page_number, CAST(i % 25 AS INT) AS reading_order, i, parts[i + 1] AS text FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))), blocks AS (SELECT lines.*, raw_name, {_TYPE} AS type, trim(text, {_TRIM}) AS said FROM lines JOIN (VALUES {_HERON}) AS h(class_id, raw_name) ON i % 17 = class_id)"
_BULLET = "'- ' || coalesce(nullif(regexp_replace(said, '^[-*•· ]+', ''), ''), said)"
_MARKDOWN = f"CASE WHEN type = 'Figure' THEN '*[Figure]*' WHEN type = 'Table' THEN coalesce(nullif(said, ''), '*[Table]*') WHEN type = 'Formula' THEN coalesce(nullif(said, ''), '*[Formula]*') WHEN said = '' THEN NULL WHEN type = 'Title' THEN '# ' || said WHEN type = 'SectionHeader' THEN '## ' || said WHEN type = 'Caption' THEN '*' || said || '*' WHEN type = 'List' THEN {_BULLET} WHEN type IN ('Text', 'Footnote', 'KeyValueRegion', 'Other') THEN said END"


def _document(value: str, blocks: str, pages: str, name: str) -> str:
    return f"{_LINES}, paged AS (SELECT doc_id, page_number, coalesce(string_agg({value}, {blocks} ORDER BY reading_order), '') AS v FROM blocks GROUP BY doc_id, page_number) SELECT doc_id, rtrim(string_agg(v, {pages} ORDER BY page_number), {_TRIM}) AS {name} FROM paged GROUP BY doc_id"


_RECT = {"px": "least(x1, 762)", "py": "least(y1, 1000)", "pr": "least(x2, 762)", "pb": "least(y2, 1000)"}
_CROP = ", ".join(f"CAST(round_even(greatest(0.0::DOUBLE, {e}), 0) AS INT) AS {n}" for n, e in _RECT.items())
_RECOGNIZED = f"{_ANALYZED}, crops AS (SELECT *, {_CROP} FROM analyzed), sized AS (SELECT *, greatest(0, pr - px) AS w, greatest(0, pb - py) AS h FROM crops), routed AS (SELECT *, CASE WHEN w >= 2 AND h >= 2 THEN CASE WHEN type IN {_strings(TEXT_BEARING)} THEN 'text' WHEN type = 'Table' THEN 'table' WHEN type = 'Formula' THEN 'formula' END END AS route FROM sized), answered AS (SELECT *, CASE WHEN route = 'text' THEN w || 'x' || h END AS text, CASE WHEN route = 'formula' THEN w || 'x' || h END AS latex, CASE WHEN route = 'table' THEN 3 END AS table_columns FROM routed)"

_CUSTOM_TYPE = _case("label", LABELS, _case("spelled", LABELS, _case("spelled", _SPELLINGS, "'Other'")))
_MAPPED = "CASE " + " ".join(f"WHEN label = {_text(a)} THEN {_text(b)}" for a, b in CUSTOM_MAP.items()) + f" ELSE {_CUSTOM_TYPE} END"
_BUILT_IN = ", ".join(f"({_text(m)}, {_text(x)})" for m, x in [(m, x) for m, xs in VOCABULARIES.items() for x in xs] + [("none", x) for x in ("Title", "stamp", "table_title", "chart_title", "nothing", "")])
_PAIR_KEYS = ", ".join(f"a.{k} AS {k}_a" for k in derived.DET_KEY) + ", " + ", ".join(f"b.{k} AS {k}_b" for k in derived.DET_KEY)
# Each region gets one number per page first, so that pairs are a hash join on the page and one comparison.
_PAIRS = f"{_STRONG}, numbered AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY {_KEY}) AS place FROM strong)"
_OF_PAIRS = "FROM numbered a JOIN numbered b ON a.page_id = b.page_id WHERE a.place < b.place"
_ORIENT = "WITH four AS (SELECT vec_id, CAST(k AS INT) AS k, embedding[4 * k + 1:4 * k + 4] AS e FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 4)) AS k FROM embeddings)), given AS (SELECT vec_id, k, CASE WHEN (vec_id + k) % 3 = 0 THEN list_transform(e, lambda x: abs(CAST(x AS DOUBLE)) / list_sum(list_transform(e, lambda y: abs(CAST(y AS DOUBLE))))) ELSE list_transform(e, lambda x: CAST(x AS DOUBLE)) END AS v FROM four), judged AS (SELECT vec_id, k, v, (vec_id + k) % 3 = 0 OR (list_min(v) >= 0 AND list_max(v) <= 1 AND abs(list_sum(v) - 1) <= 0.01) AS given_p FROM given), soft AS (SELECT vec_id, k, CASE WHEN given_p THEN v ELSE list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) END AS p FROM judged), best AS (SELECT vec_id, k, p, CAST((list_position(p, list_max(p)) - 1) * 90 AS INT) AS rotation, list_max(p) AS confidence FROM soft)"

# Pages made of the bytes of texts, in hexadecimal: frame number, width, height, gray bytes.
_FRAMES = "WITH bytes AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text IS NOT NULL), frames AS (SELECT doc_id, CAST(1 AS INT) AS page_number, CAST(32 AS INT) AS width, CAST(n // 32 AS INT) AS height, substr(h, 1, CAST(n // 32 * 64 AS BIGINT)) AS gray FROM bytes WHERE n >= 32 UNION ALL SELECT doc_id, CAST(CASE WHEN n >= 32 THEN 2 ELSE 1 END AS INT), CAST(n % 32 AS INT), CAST(1 AS INT), substr(h, CAST(n // 32 * 64 + 1 AS BIGINT)) FROM bytes WHERE n % 32 > 0)"


def _pixels(gray: str) -> str:
    return f"sha256(unhex(regexp_replace({gray}, '(..)', '\\1\\1\\1', 'g')))"


#: Rows of the scripted detectors: position, class, score, order, box in input pixels.
_SCRIPT = {"paddle": "(0, 1, 0.9, 2, 8, 8, 40, 24), (1, 0, 0.75, 0, 0, 32, 64, 64)", "yolo": "(0, 1, 0.9, -1, 8, 8, 40, 24), (1, 0, 0.625, -1, 16, 32, 60, 60)"}


def _found(contract: str) -> str:
    content = {s: f"greatest(1, least(64, CAST(round_even({s} * scale, 0) AS INT)))" for s in ("width", "height")}
    back = {
        "paddle": lambda c, s: f"CAST({c} AS DOUBLE) * ({s} / 64.0::DOUBLE)",
        "yolo": lambda c, s: f"greatest(0.0::DOUBLE, least(CAST({s} AS DOUBLE), (CAST({c} AS DOUBLE) - (64 - {content[s]}) / 2.0::DOUBLE) / scale))",
    }[contract]
    box = ", ".join(f"{back(c, 'width' if c[0] == 'x' else 'height')} AS {c}" for c in ("x1", "y1", "x2", "y2"))
    return f"{_FRAMES}, said(det_pos, class_id, score, order_hint, x1, y1, x2, y2) AS (VALUES {_SCRIPT[contract]}), scaled AS (SELECT *, least(64 / CAST(width AS DOUBLE), 64 / CAST(height AS DOUBLE)) AS scale FROM frames), boxes AS (SELECT doc_id, page_number, CAST(det_pos AS INT) AS det_pos, CAST(class_id AS INT) AS class_id, CAST(score AS FLOAT) AS score, CAST(order_hint AS INT) AS order_hint, {box} FROM scaled CROSS JOIN said) SELECT doc_id, page_number, det_pos, class_id, score, order_hint, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2 FROM boxes WHERE x2 - x1 >= 1 AND y2 - y1 >= 1"


ORACLE_SQL: dict[str, str] = {
    "dets_filtered": f"{_STRONG} SELECT page_id, {_KEY}, class_id, raw_name, type, score, order_hint, x1, y1, x2, y2 FROM strong",
    "type_counts": f"{_kept(None)} SELECT type, count(*) AS n_blocks FROM kept GROUP BY type",
    "box_geometry": f"{_BASE} SELECT page_id, {_KEY}, {_width('')} AS width, {_height('')} AS height, {_area('')} AS area, x1 + {_width('')} / 2 AS center_x, y1 + {_height('')} / 2 AS center_y, {_width('')} <= 0 AND {_height('')} <= 0 AS is_empty FROM dets",
    "pixel_rect": f"{_BASE}, r AS (SELECT page_id, {_KEY}, CAST(round_even(least(x1 / 2, 380), 0) AS INT) AS px, CAST(round_even(least(y1 / 2, 498), 0) AS INT) AS py, CAST(round_even(least(x2 / 2, 380), 0) AS INT) AS pr, CAST(round_even(least(y2 / 2, 498), 0) AS INT) AS pb FROM dets) SELECT page_id, {_KEY}, px, py, greatest(0, pr - px) AS pw, greatest(0, pb - py) AS ph FROM r",
    "box_iou_pairs": f"{_PAIRS} SELECT a.page_id, {_PAIR_KEYS}, {_shared('a.', 'b.')} AS shared, round({_iou('a.', 'b.')}, 9) AS iou {_OF_PAIRS} AND {_iou('a.', 'b.')} > {_IOU_LIMIT}",
    "containment_pairs": f"{_PAIRS} SELECT a.page_id, {_PAIR_KEYS}, a.type AS type {_OF_PAIRS} AND a.type = b.type AND {_shared('a.', 'b.')} > 0 AND {_area('b.')} > 0 AND {_shared('a.', 'b.')} / {_area('b.')} >= 0.9",
    "dedupe_blocks": f"{_kept(None)} SELECT page_id, {_KEY}, CAST(rank AS INT) AS rank, type, score FROM kept",
    "dedupe_cleanup": f"{_kept(0.005)} SELECT page_id, {_KEY}, CAST(rank AS INT) AS rank, type, score FROM kept",
    "order_choice": f"{_kept(0.001)}, every AS (SELECT DISTINCT page_id FROM strong) SELECT page_id, CASE WHEN bool_and(order_hint >= 0) THEN 'model' ELSE 'xycut' END AS strategy, CAST(count(rank) AS INT) AS n_blocks FROM every LEFT JOIN kept USING (page_id) GROUP BY page_id",
    "model_order": f"{_ANALYZED} SELECT page_id, {_KEY}, type, order_hint, reading_order FROM analyzed WHERE strategy = 'model'",
    "furniture_pin": f"{_ANALYZED} SELECT page_id, band, min(reading_order) AS first, max(reading_order) AS last, count(*) AS n FROM analyzed GROUP BY page_id, band",
    "xycut_splits": f"{_kept(0.001)}, g AS (SELECT *, y1 - max(y2) OVER (PARTITION BY page_id ORDER BY y1, y2, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM kept) SELECT page_id, {_KEY}, gap, coalesce(gap > -5, FALSE) AS is_cut, CAST(sum(CAST(coalesce(gap > -5, FALSE) AS INT)) OVER (PARTITION BY page_id ORDER BY y1, y2, rank ROWS UNBOUNDED PRECEDING) AS INT) AS segment FROM g",
    "xycut_order": f"{_kept(0.001)}, items AS (SELECT page_id, rank, x1, y1, x2, y2 FROM kept){_cut('page_id', 5.0)} SELECT kept.page_id, {_KEY}, CAST(row_number() OVER (PARTITION BY kept.page_id ORDER BY path) - 1 AS INT) AS reading_order FROM kept JOIN placed ON kept.page_id = placed.page_id AND kept.rank = placed.rank",
    "analyze_blocks": f"{_ANALYZED} SELECT page_id, strategy, {_KEY}, class_id, raw_name, type, score, x1, y1, x2, y2, reading_order FROM analyzed",
    "type_map_builtin": f"WITH l(model, label) AS (VALUES {_BUILT_IN}), t AS (SELECT model, label, {_case('label', LABELS, chr(39) + 'Other' + chr(39))} AS type FROM l) SELECT model, label, type, type IN {_strings(TEXT_BEARING)} AS text_bearing, type IN {_strings(FURNITURE)} AS furniture, lang, n_docs FROM t CROSS JOIN (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)",
    "type_map_custom": f"WITH l(label) AS (VALUES {', '.join(f'({_text(x)})' for x in CUSTOM_LABELS)}), s AS (SELECT label, lower(replace(replace(trim(label), '-', '_'), ' ', '_')) AS spelled FROM l) SELECT lang, label, {_CUSTOM_TYPE} AS type, {_MAPPED} AS mapped_type FROM s CROSS JOIN (SELECT DISTINCT lang FROM documents)",
    "decode_paddle": _decoded("{} * (width / 800.0::DOUBLE)", "{} * (height / 800.0::DOUBLE)", "CASE WHEN order_hint >= 0 THEN order_hint ELSE -1 END", 0.75),
    "decode_yolo": _decoded("({} - pad_x) / scale", "({} - pad_y) / scale", "-1", 0.625, f", {_SCALE} AS scale, {_PAD['width']} AS pad_x, {_PAD['height']} AS pad_y"),
    "decode_detr": "WITH q AS (SELECT vec_id, CAST(unnest([0, 1, 2]) AS INT) AS det_pos, embedding FROM embeddings), l AS (SELECT vec_id, det_pos, embedding[det_pos * 17 + 1:det_pos * 17 + 17] AS lg, list_transform(embedding[52 + det_pos * 4:55 + det_pos * 4], lambda x: abs(x)) AS b FROM q), s AS (SELECT vec_id, det_pos, CAST(list_position(lg, list_max(lg)) - 1 AS INT) AS class_id, CAST(list_max(lg) AS DOUBLE) AS best, b FROM l WHERE list_max(lg) >= CAST(ln(CAST(0.55 AS DOUBLE) / (1 - CAST(0.55 AS DOUBLE))) AS FLOAT)), c AS (SELECT vec_id, det_pos, class_id, 1 / (1 + exp(-best)) AS score, greatest(0.0::DOUBLE, least(762.0::DOUBLE, CAST((b[1] - b[3] / 2) * 762 AS DOUBLE))) AS x1, greatest(0.0::DOUBLE, least(1000.0::DOUBLE, CAST((b[2] - b[4] / 2) * 1000 AS DOUBLE))) AS y1, greatest(0.0::DOUBLE, least(762.0::DOUBLE, CAST((b[1] + b[3] / 2) * 762 AS DOUBLE))) AS x2, greatest(0.0::DOUBLE, least(1000.0::DOUBLE, CAST((b[2] + b[4] / 2) * 1000 AS DOUBLE))) AS y2 FROM s) SELECT vec_id, det_pos, class_id, round(score, 4) AS score, round(x1, 2) AS x1, round(y1, 2) AS y1, round(x2, 2) AS x2, round(y2, 2) AS y2 FROM c WHERE x2 - x1 >= 1 AND y2 - y1 >= 1",
    "letterbox": f"SELECT page_id, round({_SCALE}, 9) AS scale, {_CONTENT['width']} AS content_width, {_CONTENT['height']} AS content_height, {_PAD['width']} AS pad_x, {_PAD['height']} AS pad_y, {_PLACE['width']} AS \"left\", {_PLACE['height']} AS top FROM ({derived.PAGES})",
    "orientation_decode": f"{_ORIENT} SELECT vec_id, k, rotation, round(confidence, 2) AS confidence, round(p[1], 2) AS p0, round(p[2], 2) AS p90, round(p[3], 2) AS p180, round(p[4], 2) AS p270, rotation <> 0 AND confidence >= CAST(0.6 AS FLOAT) AS applied FROM best",
    "map_to_source_points": f"{_CORRECTED} SELECT page_id, round({_source('10.0::DOUBLE', '20.0::DOUBLE')[0]}, 6) AS x, round({_source('10.0::DOUBLE', '20.0::DOUBLE')[1]}, 6) AS y, CASE WHEN rotation IN (90, 270) THEN height ELSE width END AS upright_w, CASE WHEN rotation IN (90, 270) THEN width ELSE height END AS upright_h, rotation <> 0 OR skew <> 0 AS is_corrected FROM upright",
    "map_to_source_boxes": f"{_CORRECTED}, det_base AS ({derived.DET_BASE}), dets AS ({derived.DETS}) SELECT page_id, {_KEY}, round(least({', '.join(c[0] for c in _CORNERS)}), 5) AS sx1, round(least({', '.join(c[1] for c in _CORNERS)}), 5) AS sy1, round(greatest({', '.join(c[0] for c in _CORNERS)}), 5) AS sx2, round(greatest({', '.join(c[1] for c in _CORNERS)}), 5) AS sy2 FROM dets JOIN upright USING (page_id)",
    "luma_histogram": f"{_GRAY} SELECT event_type, luma, count(*) AS n FROM gray GROUP BY event_type, luma",
    "otsu_histogram": f"{_GRAY}, h AS (SELECT event_type, luma AS t, CAST(count(*) AS DOUBLE) AS n FROM gray GROUP BY event_type, luma), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY t) AS w, sum(t * n) OVER (PARTITION BY event_type ORDER BY t) AS s, sum(n) OVER (PARTITION BY event_type) AS total, sum(t * n) OVER (PARTITION BY event_type) AS ts FROM h), v AS (SELECT *, w * (total - w) * (s / w - (ts - s) / (total - w)) * (s / w - (ts - s) / (total - w)) AS variance FROM c WHERE w < total), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY variance DESC, t) AS place FROM v) SELECT event_type, CAST(t + 1 AS INT) AS threshold, CAST(total AS BIGINT) AS n_pixels FROM r WHERE place = 1",
    "projection_sharpness": f"{_GRAY}, ink AS (SELECT event_type, CAST(event_id % 97 AS INT) AS bin FROM gray WHERE luma < 128), dense AS (SELECT e.event_type, b.bin, (SELECT count(*) FROM ink WHERE ink.event_type = e.event_type AND ink.bin = b.bin) AS n FROM (SELECT DISTINCT event_type FROM ink) e CROSS JOIN (SELECT unnest(range(0, 97)) AS bin) b), d AS (SELECT event_type, n - lag(n) OVER (PARTITION BY event_type ORDER BY bin) AS d FROM dense) SELECT event_type, CAST(sum(d * d) AS BIGINT) AS sharpness FROM d GROUP BY event_type",
    "table_html": f"{_TABLES} {_html('cells')}",
    "table_parse": f"{_TABLES}, n AS (SELECT ok, CAST(max(r) + 1 AS INT) AS row_count FROM cells GROUP BY ok) SELECT ok, row_count, 4 AS column_count, r AS \"row\", c AS \"column\", rowspan AS row_span, colspan AS column_span, is_header, txt AS text FROM cells JOIN n USING (ok)",
    "table_grid": f"{_GRID} SELECT ok, \"row\", \"column\", text FROM grid",
    "table_csv": f"{_GRID}, c AS (SELECT ok, \"row\", string_agg({_csv(chr(39) + ',' + chr(39))}, ',' ORDER BY \"column\") || chr(13) || chr(10) AS csv, string_agg({_csv('chr(9)')}, chr(9) ORDER BY \"column\") || chr(13) || chr(10) AS tsv FROM grid GROUP BY ok, \"row\") SELECT ok, string_agg(csv, '' ORDER BY \"row\") AS csv, string_agg(tsv, '' ORDER BY \"row\") AS tsv FROM c GROUP BY ok",
    "table_markdown": f"{_GRID}, narrow AS (SELECT * FROM cells WHERE ok % 2 = 1 OR c > 0), spans AS (SELECT ok, bool_or(rowspan > 1) AS spans FROM narrow GROUP BY ok), html AS ({_html('narrow')}), md AS (SELECT ok, \"row\", '| ' || string_agg(replace(text, '|', '\\|'), ' | ' ORDER BY \"column\") || ' |' || CASE WHEN \"row\" = 0 THEN chr(10) || '|' || repeat(' --- |', count(*)) ELSE '' END AS line FROM grid WHERE ok % 2 = 1 OR \"column\" > 0 GROUP BY ok, \"row\"), pipes AS (SELECT ok, string_agg(line, chr(10) ORDER BY \"row\") AS pipes FROM md GROUP BY ok) SELECT ok, CASE WHEN spans THEN html ELSE pipes END AS markdown FROM spans JOIN html USING (ok) JOIN pipes USING (ok)",
    "table_offset": f"{_TABLES} SELECT ok, r AS \"row\", c AS \"column\", CAST(c * 10 + ok AS DOUBLE) AS min_x, c * 10 + 1.5::DOUBLE AS min_y, CAST(c * 10 + 2 + ok AS DOUBLE) AS max_x, c * 10 + 3.5::DOUBLE AS max_y FROM cells",
    "plain_text": _document("CASE WHEN said <> '' THEN text END", "chr(10)", "chr(10) || chr(10)", "text"),
    "markdown": _document(_MARKDOWN, "chr(10) || chr(10)", "chr(10) || chr(10) || '---' || chr(10) || chr(10)", "markdown"),
    "json_roundtrip": f"{_ANALYZED}, pages AS ({derived.PAGES}) SELECT CAST(floor(page_id / 4) AS BIGINT) AS doc, CAST(page_id % 4 + 1 AS INT) AS page_number, rotation, skew AS skew_angle, type, score AS confidence, reading_order, class_id AS raw_class_id, raw_name AS raw_class_name, x1 AS min_x, y1 AS min_y, x2 AS max_x, y2 AS max_y FROM analyzed JOIN pages USING (page_id)",
    "latex_normalize": f"WITH w AS (SELECT doc_id, trim(CASE doc_id % 7 WHEN 0 THEN '$$ ' || text || ' $$' WHEN 1 THEN '  $' || text || '$ ' WHEN 2 THEN '\\[' || text || '\\]' WHEN 3 THEN '\\(' || text || '\\)' ELSE text END, {_TRIM}) AS t FROM documents), b AS (SELECT doc_id, CASE WHEN length(t) >= 4 AND starts_with(t, '$$') AND ends_with(t, '$$') OR length(t) >= 4 AND starts_with(t, '\\[') AND ends_with(t, '\\]') OR length(t) >= 4 AND starts_with(t, '\\(') AND ends_with(t, '\\)') THEN substr(t, 3, length(t) - 4) WHEN length(t) >= 2 AND starts_with(t, '$') AND ends_with(t, '$') THEN substr(t, 2, length(t) - 2) ELSE t END AS bare FROM w) SELECT doc_id, nullif(trim(bare, {_TRIM}), '') AS latex FROM b",
    "page_numbering": "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS page_number FROM conversations",
    "guard_pages": "SELECT conv_id, least(count(*), 5) AS n_pages, CASE WHEN count(*) > 4 THEN 'document has 5 pages; at most 4 are allowed' END AS error FROM conversations GROUP BY conv_id",
    "guard_pixels": f"SELECT page_id, CASE WHEN CAST(width AS BIGINT) * height * 1000000 > 900000000000 THEN 'image has ' || (CAST(width AS BIGINT) * height * 1000000) || ' pixels; at most 900000000000 are allowed' END AS error FROM ({derived.PAGES})",
    "recognize_text": f"{_RECOGNIZED} SELECT page_id, {_KEY}, type, text, latex, table_columns FROM answered",
    "recognize_routing": f"{_RECOGNIZED} SELECT type, count(*) AS n, count(text) AS with_text, count(latex) AS with_latex, count(table_columns) AS with_table FROM answered GROUP BY type",
}
_JSON_BOX = {"MinX": "x1", "MinY": "y1", "MaxX": "x2", "MaxY": "y2", "Width": _width(""), "Height": _height(""), "Area": _area(""), "CenterX": f"(x1 + {_width('')} / 2)", "CenterY": f"(y1 + {_height('')} / 2)", "IsEmpty": f"({_width('')} <= 0 AND {_height('')} <= 0)"}
_BOX_JSON = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in _JSON_BOX.items())
_BLOCK_JSON = f"""'{{"Type":"' || type || '","BoundingBox":{{' || {_BOX_JSON} || '}},"Confidence":' || score || ',"ReadingOrder":' || reading_order || ',"RawClassId":' || class_id || ',"RawClassName":"' || raw_name || '"}}'"""
ORACLE_SQL |= {
    "decode_counted": f"{_packed(0.75)}, odd AS (SELECT packed.*, pk % 11 AS k FROM packed JOIN (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY {_KEY}, class_id, score, x1, y1, x2, y2) - 1 AS INT) AS det_pos, pk FROM dets) USING (page_id, det_pos)), boxes AS (SELECT page_id, det_pos, class_id, score, CASE WHEN k <> 3 AND order_hint >= 0 THEN order_hint ELSE -1 END AS order_hint, {', '.join(_clamped(f'f{c} * ({s} / 800.0::DOUBLE)', s) + f' AS {c}' for c, s in (('x1', 'width'), ('y1', 'height'), ('x2', 'width'), ('y2', 'height')))} FROM odd JOIN pages USING (page_id) WHERE k > 2 AND score >= CAST(0.5 AS FLOAT) AND (page_id % 8 = 0 OR det_pos < page_id % 8)) SELECT page_id, det_pos, class_id, score, CAST(order_hint AS INT) AS order_hint, round(x1, 3) AS x1, round(y2, 3) AS y2 FROM boxes WHERE x2 - x1 >= 1 AND y2 - y1 >= 1",
    "table_empty": f"{_TABLES}, kept AS (SELECT * FROM cells WHERE c >= ok % 6) SELECT ok, count(c) = 0 AS is_empty, CAST(coalesce(max(r + rowspan), 0) AS INT) AS row_count, CAST(coalesce(max(c + 1), 0) AS INT) AS column_count FROM (SELECT DISTINCT ok FROM cells) LEFT JOIN kept USING (ok) GROUP BY ok",
    "markdown_blocks": f"{_GRID}, spans AS (SELECT ok, bool_or(rowspan > 1) AS spans FROM cells GROUP BY ok), html AS ({_html('cells')}), md AS (SELECT ok, \"row\", '| ' || string_agg(replace(text, '|', '\\|'), ' | ' ORDER BY \"column\") || ' |' || CASE WHEN \"row\" = 0 THEN chr(10) || '|' || repeat(' --- |', count(*)) ELSE '' END AS line FROM grid GROUP BY ok, \"row\"), pipes AS (SELECT ok, string_agg(line, chr(10) ORDER BY \"row\") AS pipes FROM md GROUP BY ok), shown AS (SELECT ok, CASE WHEN spans THEN html ELSE pipes END AS md, CASE WHEN ok % 2 = 0 THEN 'said ' || ok END AS said, CASE WHEN ok % 3 <> 0 THEN 'x^{{' || ok || '}}' END AS latex FROM spans JOIN html USING (ok) JOIN pipes USING (ok)) SELECT ok, type, CASE type WHEN 'Table' THEN CASE WHEN ok % 5 = 0 THEN coalesce(said, '*[Table]*') ELSE md END WHEN 'Formula' THEN coalesce('$$' || chr(10) || latex || chr(10) || '$$', said, '*[Formula]*') ELSE said END AS markdown, CASE WHEN type <> 'Table' THEN coalesce(latex, ' ' || said || chr(10)) END AS plain FROM shown CROSS JOIN (VALUES ('Table'), ('Formula'), ('Text')) AS t(type)",
    "table_bridge": f"{_TABLES}, sized AS (SELECT ok, ok // 4 AS near, CAST(count(*) AS INT) AS n, CAST(max(r + rowspan) AS INT) AS rows_, max(CASE WHEN c = 3 THEN txt END) AS said FROM cells GROUP BY ok), best AS (SELECT *, row_number() OVER (PARTITION BY near ORDER BY n DESC, ok) AS by_size, row_number() OVER (PARTITION BY near ORDER BY length(said) DESC, ok) AS by_length FROM sized) SELECT near, max(CASE WHEN by_size = 1 THEN n END) AS n_cells, max(CASE WHEN by_size = 1 THEN rows_ END) AS row_count, max(CASE WHEN by_length = 1 THEN said END) AS longest FROM best GROUP BY near",
    "image_frames": f"{_FRAMES}, every AS (SELECT doc_id, page_number, width, height, {_pixels('gray')} AS pixels_sha256, FALSE AS failed FROM frames) SELECT * FROM every UNION ALL SELECT doc_id, CAST(1 AS INT), NULL, NULL, NULL, TRUE FROM documents WHERE coalesce(text, '') = ''",
    "image_upright": f"{_FRAMES} SELECT doc_id, page_number, CASE WHEN doc_id % 10 >= 6 THEN 180 ELSE 0 END AS rotation, 0.0::DOUBLE AS skew_angle, width, height, CASE WHEN doc_id % 10 >= 6 THEN {_pixels(chr(34) + 'turned' + chr(34))} ELSE {_pixels('gray')} END AS pixels_sha256 FROM (SELECT *, array_to_string(list_reverse(regexp_extract_all(gray, '..')), '') AS turned FROM frames)",
    "image_crops": f"{_FRAMES} SELECT doc_id, page_number, width, CAST(height // 3 AS INT) AS height, {_pixels('substr(gray, 2 * width * (height // 3) + 1, 2 * width * (height // 3))')} AS pixels_sha256 FROM frames WHERE height >= 3",
    "detect_paddle": _found("paddle"),
    "detect_yolo": _found("yolo"),
    "doc_json": f"{_ANALYZED}, pages AS ({derived.PAGES}), written AS (SELECT page_id, string_agg({_BLOCK_JSON}, ',' ORDER BY reading_order) AS b FROM analyzed GROUP BY page_id) SELECT CAST(floor(page_id / 4) AS BIGINT) AS doc, '{{\"Pages\":[' || string_agg('{{\"PageNumber\":' || (page_id % 4 + 1) || ',\"Width\":762,\"Height\":1000,\"Blocks\":[' || coalesce(b, '') || '],\"Rotation\":' || rotation || ',\"SkewAngle\":' || skew || ',\"SourceWidth\":' || width || ',\"SourceHeight\":' || height || ',\"IsCorrected\":' || (rotation <> 0 OR skew <> 0) || '}}', ',' ORDER BY page_id) || ']}}' AS json FROM pages LEFT JOIN written USING (page_id) GROUP BY 1",
    "page_skew": f"SELECT page_id, CAST((page_id % 5 - 2) * 3 AS DOUBLE) AS drawn, CAST((page_id % 5 - 2) * 3 AS INT) AS nearest, page_id % 5 <> 2 AS reliable, TRUE AS within FROM ({derived.PAGES})",
    "json_fields": f"{_ANALYZED}, pages AS ({derived.PAGES}) SELECT CAST(floor(page_id / 4) AS BIGINT) AS doc, CAST(page_id % 4 + 1 AS INT) AS page_number, 762 AS page_width, height AS source_height, rotation <> 0 OR skew <> 0 AS is_corrected, type, reading_order, x1 AS min_x, y2 AS max_y, {_width('')} AS width, {_height('')} AS height, {_area('')} AS area, x1 + {_width('')} / 2 AS center_x, y1 + {_height('')} / 2 AS center_y, {_width('')} <= 0 AND {_height('')} <= 0 AS is_empty FROM analyzed JOIN pages USING (page_id)",
}
