"""The queries' SQL for DuckDB, from the tables alone."""

from __future__ import annotations

from textframes.queries import BIAS, WEIGHT

#: The clip of queries.clip as pixels, and its frames.
CLIP = """
r AS (SELECT vec_id AS v, embedding AS e, unnest(range(0, CAST(vec_id % 4 + 1 AS BIGINT))) AS j FROM embeddings),
f AS (SELECT CAST(row_number() OVER (ORDER BY v, j) - 1 AS BIGINT) AS fi, v, j, e FROM r),
q AS (SELECT fi, v, j, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x,
             greatest(0, least(255, CAST(floor(CAST(e[p + 1] AS DOUBLE) * 255 + 128) AS INTEGER))) AS g FROM f, range(0, 64) t(p)),
px AS (SELECT fi, y, x, CASE WHEN v % 3 = 0 AND j >= 1 AND y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4 THEN 255 - g ELSE g END AS g FROM q)
"""


def _otsu(name: str, source: str, key: str) -> str:
    """CTEs that give `name` (key, threshold) of the histograms `source` (key, g, n)."""
    return f"""
{name}_c AS (SELECT {key}, g, CAST(sum(n) OVER b AS DOUBLE) AS wb, CAST(sum(n) OVER a AS DOUBLE) AS w,
  CAST(sum(n * g) OVER b AS DOUBLE) AS mb, CAST(sum(n * g) OVER a AS DOUBLE) AS m FROM {source}
  WINDOW a AS (PARTITION BY {key}), b AS (PARTITION BY {key} ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}_s AS (SELECT {key}, g, CASE WHEN wb < w THEN wb * (w - wb) * (mb / wb - (m - mb) / (w - wb)) * (mb / wb - (m - mb) / (w - wb)) ELSE -1 END AS s FROM {name}_c),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, g) AS k FROM {name}_s),
{name} AS (SELECT {key}, CAST(CASE WHEN s > 0 THEN g ELSE 127 END AS INTEGER) AS threshold FROM {name}_r WHERE k = 1)
"""


FEATURES = CLIP + ", sh AS (SELECT fi, stddev_pop(CAST(g AS DOUBLE)) AS sharp, count(*) * sum(g * g) - sum(g) * sum(g) AS spread FROM px GROUP BY fi), h AS (SELECT fi, g, count(*) AS n FROM px GROUP BY fi, g)," + _otsu("o", "h", "fi")
POOL = ", ph AS (SELECT 0 AS z, g, CAST(sum(n) AS BIGINT) AS n FROM h WHERE fi < 50 GROUP BY g)," + _otsu("po", "ph", "z")
FIRST = "SELECT CAST(floor(quantile_cont(CAST(threshold AS DOUBLE), 0.5)) AS INTEGER) AS threshold FROM o WHERE fi < 50"
STRIDED = """SELECT CAST(floor(quantile_cont(CAST(threshold AS DOUBLE), 0.5)) AS INTEGER) AS threshold FROM o, (SELECT greatest(1, count(*) // 50) AS step FROM f) c
WHERE fi % step = 0 AND fi < step * 50"""
#: Chunk of each frame and the thresholds of chunks.
CHUNKS = """
, cn AS (SELECT count(*) AS n, least(count(*), greatest(2, least(4, greatest(2, count(*) // 16)))) AS c FROM f),
ck AS (SELECT fi, i AS chunk, fi - i * n // c AS k FROM f, cn, range(0, 4) t(i) WHERE i < c AND fi >= i * n // c AND fi < (i + 1) * n // c)
"""


CHUNK_FIRST = "SELECT chunk, CAST(floor(quantile_cont(CAST(threshold AS DOUBLE), 0.5)) AS INTEGER) AS threshold FROM o JOIN ck USING (fi) WHERE k < 50 GROUP BY chunk"


def _segments(threshold: str, chunked: bool = False) -> str:
    """CTEs up to `sg` (chunk, seg, start_fi, end_fi, n, rep_frame) and `z` (fi, seg); threshold: rows of th."""
    chunks = CHUNKS if chunked else ", ck AS (SELECT fi, 0 AS chunk, fi AS k FROM f)"
    return f"""
{chunks}, th AS ({threshold}),
b AS (SELECT ck.chunk, ck.k, px.fi, y, x, g > threshold AS bit FROM px JOIN ck USING (fi) JOIN th {"USING (chunk)" if chunked else "ON true"}),
ch AS (SELECT c.chunk, c.k, c.fi, c.y, c.x, CAST(c.bit <> p.bit AS INTEGER) AS d FROM b c JOIN b p ON p.chunk = c.chunk AND p.k = c.k - 1 AND p.y = c.y AND p.x = c.x),
r1 AS (SELECT *, sum(d) OVER (PARTITION BY fi, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM ch),
r2 AS (SELECT *, sum(a) OVER (PARTITION BY fi, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM r1),
sc AS (SELECT fi, CAST(max(s) AS INTEGER) AS score FROM r2 GROUP BY fi),
z AS (SELECT ck.chunk, ck.fi, spread, CAST(sum(CASE WHEN score >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chunk ORDER BY k) AS BIGINT) AS seg
      FROM ck LEFT JOIN sc USING (fi) JOIN sh USING (fi)),
zr AS (SELECT *, row_number() OVER (PARTITION BY chunk, seg ORDER BY spread DESC, fi) AS best FROM z),
sg AS (SELECT CAST(chunk AS INTEGER) AS chunk, seg, min(fi) AS start_fi, max(fi) AS end_fi, count(*) AS n, max(fi) FILTER (best = 1) AS rep_frame FROM zr GROUP BY chunk, seg)
"""


def _merged(limit: float, chunked: bool = False) -> str:
    """CTEs up to `mg` (chunk, seg, start_fi, end_fi, n, rep_frame): each segment against the last one kept in its chunk."""
    return f"""
, bits AS (SELECT chunk, seg, list(CASE WHEN g > threshold THEN 1 ELSE 0 END ORDER BY y, x) AS b FROM sg JOIN px ON fi = rep_frame JOIN th {"USING (chunk)" if chunked else "ON true"} GROUP BY chunk, seg),
fold AS (
  SELECT chunk, seg, seg AS first, b AS anchor FROM bits WHERE seg = 0
  UNION ALL
  SELECT chunk, seg, CASE WHEN near THEN first ELSE seg END, CASE WHEN near THEN anchor ELSE b END FROM (
    SELECT n.chunk, n.seg, n.b, p.first, p.anchor, d * 255.0 / 64 <= {limit} AND d <= 32 AS near
    FROM fold p JOIN (SELECT * FROM bits) n ON n.chunk = p.chunk AND n.seg = p.seg + 1, LATERAL (SELECT list_sum(list_transform(range(1, 65), lambda i: abs(n.b[i] - p.anchor[i]))) AS d) x)),
mg AS (SELECT chunk, first AS seg, min(start_fi) AS start_fi, max(end_fi) AS end_fi, CAST(sum(n) AS BIGINT) AS n, max(rep_frame) FILTER (sg.seg = first) AS rep_frame FROM sg JOIN fold USING (chunk, seg) GROUP BY chunk, first)
"""


#: Levels of each frame as a list, row by row.
LEVELS = ", lv AS (SELECT fi, list(g ORDER BY y, x) AS g FROM px GROUP BY fi)"


def _steps(name: str, to: int, of: int = 8) -> str:
    """CTE `name` (i, lo, hi, w): between which of `of` places the i-th of `to` lies, and the share of the second."""
    return f""", {name} AS (SELECT i, CAST(floor(s) AS INTEGER) AS lo, least(CAST(floor(s) AS INTEGER) + 1, {of - 1}) AS hi, s - floor(s) AS w
              FROM (SELECT i, greatest(0, least({of - 1}, (i + CAST(0.5 AS DOUBLE)) * {of} / {to} - CAST(0.5 AS DOUBLE))) AS s FROM range(0, {to}) r(i)))"""


#: Bilinear value of list g at steps ty, tx.
BETWEEN = "((1 - ty.w) * ((1 - tx.w) * g[ty.lo * 8 + tx.lo + 1] + tx.w * g[ty.lo * 8 + tx.hi + 1]) + ty.w * ((1 - tx.w) * g[ty.hi * 8 + tx.lo + 1] + tx.w * g[ty.hi * 8 + tx.hi + 1]))"


#: Frames of clips in files of 250 frames: c (clip), fi of the frame in it, at in the whole.
IN_FILES = ", cf AS (SELECT lpad(CAST(fi // 250 AS VARCHAR), 6, '0') AS clip_id, fi % 250 AS fi, fi AS at FROM f)"
#: The SQL of the segments by any key: features of the frames at x1..x4, y1..y6 alone, as a clip of its own.
REGION = "px0 AS (SELECT fi, y - 1 AS y, x - 1 AS x, g FROM px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 4)"


def _plane(value: str, rows: int = 8) -> str:
    """SQL of a query that gives 1000 x a value of each pixel."""
    return f"WITH {CLIP} SELECT fi, y, x, CAST(floor(1000 * CAST({value} AS DOUBLE) + 0.5) AS BIGINT) AS v FROM px WHERE y < {rows}"


def oracle_sql() -> dict[str, str]:
    first = _segments(FIRST)
    row = "seg, start_fi, end_fi, rep_frame, n"
    blur = "avg(CAST(n.g AS DOUBLE))"
    k = 9  # blur_size(8)
    around = f"px p JOIN range(-{k // 2}, {k // 2 + 1}) a(dy) ON true JOIN range(-{k // 2}, {k // 2 + 1}) b(dx) ON true JOIN px n ON n.fi = p.fi AND n.y = greatest(0, least(7, p.y + dy)) AND n.x = greatest(0, least(7, p.x + dx))"
    around3 = around.replace("range(-4, 5)", "range(-1, 2)")
    return {
        "luma_range_expand": f"WITH {CLIP} SELECT fi, y, x, greatest(0, least(255, CAST(floor((CAST(g AS DOUBLE) - 16) * 255 / 219 + 0.5) AS INTEGER))) AS limited, g AS \"full\" FROM px",
        "rgb_to_gray": f"WITH {CLIP} SELECT fi, y, x, CAST(floor(CAST(g AS DOUBLE) * CAST(0.299 AS DOUBLE) + CAST(255 - g AS DOUBLE) * CAST(0.587 AS DOUBLE) + CAST((g * 7) % 256 AS DOUBLE) * CAST(0.114 AS DOUBLE)) AS INTEGER) AS gray FROM px",
        "seg_gamma": f"WITH {CLIP} SELECT fi, y, x, CAST(floor(pow(CAST(g AS DOUBLE) / 255, 2) * 255) AS INTEGER) AS \"out\" FROM px",
        "luma_plane": _plane("g", 5),
        "roi_crop": f"WITH {CLIP} SELECT fi, y - 2 AS y, x - 1 AS x, g FROM px WHERE y BETWEEN 2 AND 6 AND x BETWEEN 1 AND 5",
        "sample_stride": f"WITH {CLIP} SELECT fi, (fi - 10) // 7 AS k FROM f WHERE fi >= 10 AND (fi - 10) % 7 = 0",
        "stride_clamp": "SELECT vec_id, greatest(1, CAST(vec_id % 7 - 3 AS INTEGER)) AS stride FROM embeddings",
        "sharpness": f"WITH {FEATURES} SELECT fi, round(sharp, 6) AS sharp FROM sh",
        "histogram": f"WITH {FEATURES} SELECT fi, g, n FROM h",
        "otsu_frame": f"WITH {FEATURES} SELECT fi, threshold FROM o",
        "otsu_frame_sql": f"WITH {FEATURES} SELECT fi, threshold FROM o",
        "otsu_pooled": f"WITH {FEATURES} {POOL} SELECT threshold FROM po",
        "clip_threshold": f"WITH {FEATURES} {FIRST}",
        "clip_threshold_strided": f"WITH {FEATURES} {STRIDED}",
        "binarize": f"WITH {FEATURES}, th AS ({FIRST}) SELECT fi, y, x, CAST(g > threshold AS INTEGER) AS bit FROM px, th",
        "change_score": f"WITH {FEATURES} {first} SELECT fi, score FROM sc",
        "segments": f"WITH {FEATURES} {first} SELECT {row} FROM sg",
        "segments_serial": f"WITH {FEATURES} {_segments(STRIDED)} SELECT {row} FROM sg",
        "segments_pooled": f"WITH {FEATURES} {POOL} {_segments('SELECT threshold FROM po')} SELECT {row} FROM sg",
        "segments_chunked": f"WITH {FEATURES} {_segments(CHUNK_FIRST, True)} SELECT chunk, {row} FROM sg",
        "segments_chunked_merged": f"WITH RECURSIVE {FEATURES} {_segments(CHUNK_FIRST, True)} {_merged(90, True)} SELECT chunk, {row} FROM mg",
        "segment_frames": f"WITH {FEATURES} {first} SELECT seg, string_agg(CAST(fi AS VARCHAR), ',' ORDER BY fi) AS frames FROM z GROUP BY seg",
        "rep_frame": f"WITH {FEATURES} {first} SELECT seg, rep_frame FROM sg",
        "merge_anchored": f"WITH RECURSIVE {FEATURES} {first} {_merged(90)} SELECT {row} FROM mg",
        "merge_default": f"WITH RECURSIVE {FEATURES} {first} {_merged(3)} SELECT {row} FROM mg",
        "similar_pairs": f"""WITH {FEATURES} {first}, bp AS (SELECT seg, y, x, g > threshold AS bit FROM sg JOIN px ON fi = rep_frame, th)
            SELECT a.seg, CAST(sum(CAST(a.bit <> b.bit AS INTEGER)) * 255.0 / 64 <= 36 AND sum(CAST(a.bit <> b.bit AS INTEGER)) <= 32 AS INTEGER) AS similar
            FROM bp a JOIN bp b ON b.seg = a.seg + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.seg""",
        "mean_abs_diff": f"WITH {CLIP} SELECT a.fi AS k, CAST(floor(1000 * avg(CAST(abs(a.g - b.g) AS DOUBLE)) + 0.5) AS BIGINT) AS diff FROM px a JOIN px b ON b.fi = a.fi + 1 AND a.y = b.y AND a.x = b.x GROUP BY a.fi",
        "text_sep_binary": f"WITH {CLIP}, m AS (SELECT fi, floor(avg(CAST(g AS DOUBLE))) AS m FROM px GROUP BY fi) SELECT fi, y, x, CAST(CASE WHEN g > m THEN 255000 ELSE 0 END AS BIGINT) AS v FROM px JOIN m USING (fi)",
        "text_sep_contrast": f"""WITH {CLIP}, bl AS (SELECT p.fi, p.y, p.x, abs(81 * p.g - sum(n.g)) AS a FROM {around} GROUP BY p.fi, p.y, p.x, p.g),
            hi AS (SELECT fi, list_sort(list(a)) AS a FROM bl GROUP BY fi), hh AS (SELECT fi, 100 * a[60] + 85 * (a[61] - a[60]) AS hi FROM hi)
            SELECT fi, y, x, CAST(CASE WHEN hi > 8100 THEN least(255, 25500 * a // hi) ELSE a // 81 END AS BIGINT) AS v FROM bl JOIN hh USING (fi)""",
        "box_blur": f"WITH {CLIP} SELECT p.fi, p.y, p.x, CAST(sum(n.g) * 1000 AS BIGINT) AS v FROM {around3} GROUP BY p.fi, p.y, p.x",
        "box_blur_wide": f"WITH {CLIP} SELECT p.fi, p.y, p.x, CAST(sum(n.g) AS BIGINT) AS v FROM {around.replace('range(-4, 5)', 'range(-2, 3)')} GROUP BY p.fi, p.y, p.x",
        "luma_of_formats": f"""WITH {CLIP} SELECT fi, y, x, CAST(g AS BIGINT) AS gray,
            CAST(floor(CAST(g AS DOUBLE) * CAST(0.299 AS DOUBLE) + CAST(255 - g AS DOUBLE) * CAST(0.587 AS DOUBLE) + CAST(g // 2 AS DOUBLE) * CAST(0.114 AS DOUBLE)) AS BIGINT) AS rgb,
            CAST(floor(pow(CAST(g AS DOUBLE) / 255, 2) * 255) AS BIGINT) AS curved,
            CAST(CASE WHEN y < 5 THEN greatest(0, least(255, floor((CAST(g AS DOUBLE) - 16) * 255 / 219 + 0.5))) ELSE 0 END AS BIGINT) AS nv12 FROM px""",
        "resize_bilinear": f"""WITH {CLIP} {LEVELS} {_steps("t", 16)}
            SELECT fi, CAST(ty.i AS INTEGER) AS y, CAST(tx.i AS INTEGER) AS x, CAST(floor(1000 * {BETWEEN} + 0.5) AS BIGINT) AS v FROM lv, t ty, t tx""",
        "ocr_prepare": f"""WITH {FEATURES} {first} {LEVELS} {_steps("ty_", 48)} {_steps("tx_", 16)}
            SELECT seg, CAST(ty.i AS INTEGER) AS y, CAST(tx.i AS INTEGER) AS x, CAST(floor(48 * {BETWEEN} + 0.5) AS BIGINT) AS v FROM sg JOIN lv ON fi = rep_frame, ty_ ty, tx_ tx""",
        "ocr_separate": f"""WITH {FEATURES} {first} {LEVELS} {_steps("ty_", 48)} {_steps("tx_", 16)},
            pr AS (SELECT seg, ty.i AS y, tx.i AS x, CAST(floor(48 * {BETWEEN} + 0.5) AS BIGINT) AS v FROM sg JOIN lv ON fi = rep_frame, ty_ ty, tx_ tx),
            mean AS (SELECT seg, sum(v) // 768 AS m FROM pr GROUP BY seg)
            SELECT seg, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(CASE WHEN v > m THEN 255 ELSE 0 END AS BIGINT) AS v FROM pr JOIN mean USING (seg)""",
        "normalize_pad": f"""WITH {CLIP} SELECT fi, y, x, CAST(2 * g - 255 AS BIGINT) AS r, CAST(2 * (255 - g) - 255 AS BIGINT) AS g, CAST(2 * (g // 2) - 255 AS BIGINT) AS b FROM px
            UNION ALL SELECT fi, CAST(yy AS INTEGER), CAST(c AS INTEGER), 0, 0, 0 FROM f CROSS JOIN range(0, 8) u(yy) CROSS JOIN range(8, 12) t(c)""",
        "nv12_to_rgb": f"""WITH {CLIP} {LEVELS},
            c AS (SELECT px.fi, y, x, CAST(1.164383 AS FLOAT) * CAST((CAST(px.g AS FLOAT) - 16) / 255 AS FLOAT) AS l,
              CAST((CAST(lv.g[(5 + y // 2) * 8 + x // 2 * 2 + 1] AS FLOAT) - 128) / 255 AS FLOAT) AS u, CAST((CAST(lv.g[(5 + y // 2) * 8 + x // 2 * 2 + 2] AS FLOAT) - 128) / 255 AS FLOAT) AS v
              FROM px JOIN lv ON lv.fi = px.fi WHERE y < 5)
            SELECT fi, y, x, {", ".join(f"CAST(floor(CAST(greatest(0, least(1, {e})) AS FLOAT) * CAST(255 AS FLOAT)) AS BIGINT) AS {n}" for n, e in (
                ("r", "l + CAST(1.596027 AS FLOAT) * v"), ("g", "(l + CAST(-0.391762 AS FLOAT) * u) + CAST(-0.812968 AS FLOAT) * v"), ("b", "l + CAST(2.017232 AS FLOAT) * u")))} FROM c""",
        "ocr_input": """SELECT vec_id, CAST(greatest(1, (vec_id % 97 + 1) * 48 // (vec_id % 31 + 1)) AS INTEGER) AS width,
            CAST(floor(greatest(CAST(224 AS DOUBLE) / 48, CAST(vec_id % 97 + 1 AS DOUBLE) / (vec_id % 31 + 1)) * 48) AS INTEGER) AS padded FROM embeddings""",
        "ctc_decode": """WITH p AS (SELECT vec_id AS seg, s, c, embedding[s * 8 + c + 1] AS p FROM embeddings, range(0, 8) a(s), range(0, 8) b(c)),
            m AS (SELECT *, row_number() OVER (PARTITION BY seg, s ORDER BY p DESC, c) AS k FROM p),
            l AS (SELECT seg, s, c, CAST(p AS DOUBLE) AS p, lag(c) OVER (PARTITION BY seg ORDER BY s) AS before FROM m WHERE k = 1),
            t AS (SELECT * FROM l WHERE c <> 0 AND (before IS NULL OR before <> c)),
            g AS (SELECT seg, string_agg(chr(CAST(c + 96 AS INTEGER)), '' ORDER BY s) AS text, count(*) AS n, CAST(sum(CAST(round(p * 100000) AS BIGINT)) AS BIGINT) AS u FROM t GROUP BY seg)
            SELECT vec_id AS seg, text, CASE WHEN n > 0 THEN floor((2 * u + n) / CAST(2 * n AS DOUBLE)) / 100000 ELSE 0 END AS confidence, coalesce(n, 0) AS steps FROM embeddings LEFT JOIN g ON seg = vec_id""",
        "format_duration": """WITH t AS (SELECT vec_id, CAST(round_even(greatest(0, CAST(vec_id AS DOUBLE) * 37.5 - 100), 0) AS BIGINT) AS s FROM embeddings)
            SELECT vec_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0')
              ELSE (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS duration FROM t""",
        "frame_bytes": f"WITH {CLIP} SELECT fi % 10 AS part, count(*) * 64 AS bytes, count(*) AS frames FROM f GROUP BY fi % 10",
        "fps_fallback": """SELECT vec_id, CASE WHEN vec_id % 3 = 2 THEN CAST(12.5 AS DOUBLE) WHEN vec_id % 4 IN (2, 3) THEN CAST((vec_id % 4 - 1) * 10 AS DOUBLE) ELSE CAST(30 AS DOUBLE) END AS fps FROM embeddings""",
        "chunk_bounds": f"WITH {CLIP} {CHUNKS} SELECT CAST(chunk AS INTEGER) AS chunk, min(fi) AS start_fi, max(fi) AS end_fi, count(*) AS n FROM ck GROUP BY chunk",
        "hybrid_ranges": f"""WITH {CLIP}, n AS (SELECT least(count(*), greatest(50, CAST(floor(count(*) * CAST(0.4 AS DOUBLE)) AS BIGINT))) AS s FROM f)
            SELECT CASE WHEN fi < least(50, s) THEN 0 WHEN fi < s THEN 1 ELSE 2 END AS side, min(fi) AS start_fi, max(fi) AS end_fi, count(*) AS n FROM f, n GROUP BY 1""",
        "merge_cap": "SELECT vec_id, greatest(32, CAST(floor((vec_id + 1) * (vec_id % 90 + 2) * CAST(0.01 AS DOUBLE)) AS INTEGER)) AS cap FROM embeddings",
        "extract_texts": f"""WITH RECURSIVE {FEATURES} {first} {_merged(3)} {LEVELS} {_steps("ty_", 48)} {_steps("tx_", 16)},
            pr AS (SELECT seg, ty.i AS y, tx.i AS x, CAST(floor(48 * {BETWEEN} + 0.5) AS BIGINT) AS v FROM mg JOIN lv ON fi = rep_frame, ty_ ty, tx_ tx),
            bd AS (SELECT seg, x // 2 AS s, y // 24 AS b, CAST(sum(v) // (48 * 48) AS BIGINT) AS level FROM pr GROUP BY seg, x // 2, y // 24),
            wt AS (SELECT * FROM (VALUES {", ".join(f"({b}, {c}, {w})" for b, row in enumerate(WEIGHT) for c, w in enumerate(row))}) t(b, c, w)),
            bs AS (SELECT * FROM (VALUES {", ".join(f"({c}, {w})" for c, w in enumerate(BIAS))}) t(c, bias)),
            zz AS (SELECT seg, s, c, (sum(level * w) + any_value(bias)) / CAST(64 AS DOUBLE) AS z FROM bd JOIN wt USING (b) JOIN bs USING (c) GROUP BY seg, s, c),
            ez AS (SELECT seg, s, c, exp(z - max(z) OVER (PARTITION BY seg, s)) AS e FROM zz),
            so AS (SELECT seg, s, c, CAST(floor(e / sum(e) OVER (PARTITION BY seg, s) * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS q FROM ez),
            tp AS (SELECT *, row_number() OVER (PARTITION BY seg, s ORDER BY q DESC, c) AS best FROM so),
            cl AS (SELECT *, lag(c) OVER (PARTITION BY seg ORDER BY s) AS before FROM tp WHERE best = 1),
            tx AS (SELECT seg, string_agg(chr(CAST(c + 96 AS INTEGER)), '' ORDER BY s) AS text, round(avg(CAST(q AS DOUBLE) / 100), 5) AS confidence
                   FROM cl WHERE c <> 0 AND (before IS NULL OR before <> c) GROUP BY seg)
            SELECT seg, start_fi, end_fi, rep_frame, text, coalesce(confidence, 0) AS confidence FROM mg LEFT JOIN tx USING (seg)""",
        "ocr_prepare_free": f"""WITH {CLIP.replace("px AS", "whole AS")}, {REGION.replace("px0", "px").replace("FROM px ", "FROM whole ")},
            {FEATURES[len(CLIP) + 2:]} {first}, lr AS (SELECT fi, list(g ORDER BY y, x) AS g FROM px GROUP BY fi) {_steps("ty_", 48, 6)} {_steps("tx_", 32, 4)}
            SELECT seg, CAST(ty.i AS INTEGER) AS y, CAST(tx.i AS INTEGER) AS x, CAST(floor(256 * {BETWEEN.replace("* 8 +", "* 4 +")} + 0.5) AS BIGINT) AS v FROM sg JOIN lr ON fi = rep_frame, ty_ ty, tx_ tx""",
        "ocr_separate_contrast": f"""WITH {FEATURES} {first} {LEVELS} {_steps("ty_", 48)} {_steps("tx_", 16)},
            pr AS (SELECT seg, ty.i AS y, tx.i AS x, CAST(floor(48 * {BETWEEN} + 0.5) AS BIGINT) AS v FROM sg JOIN lv ON fi = rep_frame, ty_ ty, tx_ tx),
            rw AS (SELECT seg, y, list(v ORDER BY x) AS r FROM pr GROUP BY seg, y),
            hs AS (SELECT seg, y, x, list_sum(list_transform(range(-14, 15), lambda d: r[greatest(0, least(15, x + d)) + 1])) AS h FROM rw, range(0, 16) t(x)),
            co AS (SELECT seg, x, list(h ORDER BY y) AS c FROM hs GROUP BY seg, x),
            sq AS (SELECT seg, y, x, list_sum(list_transform(range(-14, 15), lambda d: c[greatest(0, least(47, y + d)) + 1])) AS s FROM co, range(0, 48) t(y)),
            ap AS (SELECT pr.seg, pr.y, pr.x, CAST(abs(841 * v - s) AS BIGINT) AS a FROM pr JOIN sq ON sq.seg = pr.seg AND sq.y = pr.y AND sq.x = pr.x),
            so AS (SELECT seg, list_sort(list(a)) AS a FROM ap GROUP BY seg), hi AS (SELECT seg, 100 * a[729] + 65 * (a[730] - a[729]) AS hi FROM so)
            SELECT seg, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(CASE WHEN hi > 84100 THEN least(255, 25500 * a // hi) ELSE least(255, a // 841) END AS BIGINT) AS v FROM ap JOIN hi USING (seg)""",
        "clip_files_gray": f"""WITH {CLIP} {IN_FILES} SELECT clip_id, cf.fi, CAST(y - 1 AS INTEGER) AS y, CAST(x - 1 AS INTEGER) AS x, greatest(0, least(255, CAST(floor((CAST(g AS DOUBLE) - 16) * 255 / 219 + 0.5) AS INTEGER))) AS g
            FROM cf JOIN px ON px.fi = cf.at WHERE cf.fi >= 3 AND (cf.fi - 3) % 2 = 0 AND y BETWEEN 1 AND 3 AND x BETWEEN 1 AND 5""",
        "clip_files_packed": f"""WITH {CLIP} {IN_FILES} SELECT clip_id, cf.fi, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS x, px.g
            FROM cf CROSS JOIN range(0, 5) a(r) CROSS JOIN range(0, 4) b(c) JOIN px ON px.fi = cf.at AND px.y = CASE WHEN r < 3 THEN r + 2 ELSE 5 + (2 + 2 * (r - 3)) // 2 END AND px.x = c + 2""",
        "segments_of_files": f"""WITH {FEATURES}, ck AS (SELECT fi, fi // 250 AS chunk, fi % 250 AS k FROM f)
            {_segments("SELECT chunk, CAST(floor(quantile_cont(CAST(threshold AS DOUBLE), 0.5)) AS INTEGER) AS threshold FROM o JOIN ck USING (fi) WHERE k < 50 GROUP BY chunk", True).replace(CHUNKS, "")}
            SELECT lpad(CAST(chunk AS VARCHAR), 6, '0') AS clip_id, seg, start_fi - 250 * chunk AS start_fi, end_fi - 250 * chunk AS end_fi, rep_frame - 250 * chunk AS rep_frame, n FROM sg""",
        "rep_crops": f"""WITH RECURSIVE {FEATURES} {first} {_merged(3)} SELECT seg, rep_frame, string_agg(lower(printf('%02x', g)), '' ORDER BY y, x) AS crop FROM mg JOIN px ON fi = rep_frame GROUP BY seg, rep_frame""",
    }
