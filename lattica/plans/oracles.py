"""The same queries as DuckDB SQL, written from the definitions rather than from the Spark code."""

from __future__ import annotations

TYPES = ("face_swap", "face_attribute", "text_swap", "text_attribute")
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _types(bits: str) -> str:
    return "list_concat(" * 3 + f"CASE WHEN {bits} & 1 > 0 THEN ['face_swap'] ELSE [] END" + "".join(f", CASE WHEN {bits} & {1 << i} > 0 THEN ['{t}'] ELSE [] END)" for i, t in enumerate(TYPES) if i)


def _csv(xs: str) -> str:
    return f"array_to_string({xs}, ',')"


def _json(types: str, box: str, pos: str) -> str:
    return (
        f"""'{{"verdict":"' || CASE WHEN len({types}) = 0 THEN 'pristine' ELSE 'manipulated' END || '","types":[' || coalesce(array_to_string(list_transform({types}, lambda t: '"' || t || '"'), ','), '')"""
        f""" || '],"image_bbox":' || CASE WHEN {box} IS NULL THEN 'null' ELSE '[' || {_csv(box)} || ']' END || ',"text_positions":[' || coalesce({_csv(pos)}, '') || ']}}'"""
    )


#: k, c, bits, types, boxes, positions of target (t…) and response (p…), ok: whether it parses; then what compares them.
BASE = f"""
WITH r0 AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
r1 AS (SELECT k, c, k % 16 AS tb, CASE WHEN c % 5 = 0 THEN (k + 3) % 16 ELSE k % 16 END AS pb, (k % 4) * (c % 30) AS s, c % 500 AS x, (k * 7) % 500 AS y, NOT (k % 7 = 0 OR (k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND (k % 19 = 0 OR k % 23 = 0))) AS ok FROM r0),
r2 AS (SELECT *, x + 1 + (c % 7) * 50 AS x2, y + 1 + (k % 50) * 8 AS y2 FROM r1),
a AS (SELECT k AS id, k, c, tb, pb, ok, {_types("tb")} AS tt, {_types("pb")} AS pt, [x, y, x2, y2] AS raw_box,
  CASE WHEN tb & 3 > 0 THEN [x, y, x2, y2] END AS tbox, CASE WHEN pb & 3 > 0 THEN [x + s, y + s, x2 + s, y2 + s] END AS pbox,
  CASE WHEN tb & 12 > 0 THEN list_sort(list_distinct([k % 50, c % 50, (k + c) % 7])) ELSE [] END AS tpos,
  CASE WHEN pb & 12 > 0 THEN list_sort(list_distinct([k % 50, (c + k % 3) % 50, (k + c) % 7])) ELSE [] END AS ppos,
  ((k * 7919 + c * 31) % 65521) / 65521.0 AS score, (10 + k % 40) AS n_words, (tb > 0)::INT AS label, CASE WHEN tb = 0 THEN 'orig' ELSE array_to_string({_types("tb")}, '&') END AS fake_cls FROM r2),
g AS (SELECT *, greatest(0.0, least(tbox[3], pbox[3]) - greatest(tbox[1], pbox[1])) * greatest(0.0, least(tbox[4], pbox[4]) - greatest(tbox[2], pbox[2]))::DOUBLE AS inter,
  ((tbox[3] - tbox[1]) * (tbox[4] - tbox[2]))::DOUBLE AS ta, ((pbox[3] - pbox[1]) * (pbox[4] - pbox[2]))::DOUBLE AS pa, len(list_intersect(tpos, ppos)) AS hits FROM a),
h AS (SELECT *, CASE WHEN tbox IS NULL AND pbox IS NULL THEN 1.0 WHEN tbox IS NULL OR pbox IS NULL THEN 0.0 ELSE inter / (ta + pa - inter) END::DOUBLE AS iou0,
  CASE WHEN len(tpos) = 0 AND len(ppos) = 0 THEN 1.0 ELSE 2.0 * hits / (len(tpos) + len(ppos)) END::DOUBLE AS wf1 FROM g),
e AS (SELECT *, CASE WHEN ok THEN iou0 ELSE 0.0 END AS iou, (score >= 0.5)::INT AS predicted,
  CASE WHEN NOT ok THEN ['invalid_json_or_schema'] ELSE list_sort(list_filter([
    CASE WHEN tbox IS NULL AND pbox IS NOT NULL THEN 'hallucinated_image_evidence' END, CASE WHEN len(tpos) = 0 AND len(ppos) > 0 THEN 'hallucinated_text_evidence' END,
    CASE WHEN iou0 < 0.5 THEN 'image_grounding' END, CASE WHEN wf1 < 1.0 THEN 'text_grounding' END, CASE WHEN tb <> pb THEN 'wrong_types' END, CASE WHEN (tb > 0) <> (pb > 0) THEN 'wrong_verdict' END], lambda t: t IS NOT NULL)) END AS errors FROM h)
"""

#: A row per sample and type: label, score, predicted.
TYPED = BASE + ", ty AS (" + " UNION ALL ".join(f"SELECT id, '{t}' AS type, (tb & {1 << i} > 0)::INT AS label, ((k * {i + 2} + c) % 10007) / 10007.0 AS score, (((k * {i + 2} + c) % 10007) / 10007.0 >= 0.5)::INT AS predicted FROM a" for i, t in enumerate(TYPES)) + ")"
CLASSES = TYPED + ", pc AS (SELECT type, sum(label * predicted) AS tp, sum((1 - label) * predicted) AS fp, sum(label * (1 - predicted)) AS fn FROM ty GROUP BY type), pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM pc)"
AP = TYPED + ", rk AS (SELECT type, label, sum(label) OVER w AS h, row_number() OVER w AS n FROM ty WINDOW w AS (PARTITION BY type ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)), ap AS (SELECT type, avg(CASE WHEN label = 1 THEN h / n END) AS ap FROM rk GROUP BY type)"
#: Cells of the word-level confusion.
WORDS = "sum(CASE WHEN ok THEN len(list_intersect(tw, pw)) ELSE 0 END)::BIGINT AS tp, sum(n_words - len(list_distinct(list_concat(tw, pw))))::BIGINT AS tn, sum(len(pw) - len(list_intersect(tw, pw)))::BIGINT AS fp, sum(len(tw) - len(list_intersect(tw, pw)))::BIGINT AS fn"
WORD_ROWS = BASE + ", wd AS (SELECT *, list_filter(tpos, lambda p: p < n_words) AS tw, CASE WHEN ok THEN list_filter(ppos, lambda p: p < n_words) ELSE [] END AS pw FROM e)"
CASES = BASE + """, cs AS (SELECT *, CASE WHEN tb = 0 THEN 'normal' WHEN tb & 3 > 0 AND tb & 12 > 0 THEN 'image_text_mixed' WHEN len(tt) = 1 THEN tt[1] WHEN tb & 3 > 0 THEN 'image_mixed' ELSE 'text_mixed' END AS kind FROM e),
cc AS (SELECT kind, count(*) AS n FROM cs GROUP BY kind), cw AS (SELECT kind, n, least(2.0, greatest(0.6, sqrt((SELECT median(n) FROM cc) / n))) AS w FROM cc)"""


def _reward(weight: str) -> str:
    return CASES + f""", rv AS (SELECT cs.id, cs.kind, ok, {weight} AS w, CASE WHEN (tb > 0) = (pb > 0) THEN 1.0 WHEN tb > 0 THEN -1.0 ELSE -0.5 END AS v,
  CASE WHEN len(tt) = 0 AND len(pt) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(tt, pt)) / (len(tt) + len(pt)) END AS t,
  CASE WHEN tb = 0 THEN (pbox IS NULL AND len(ppos) = 0)::INT::DOUBLE WHEN tb & 3 > 0 AND tb & 12 > 0 THEN (iou0 + wf1) / 2 WHEN tb & 3 > 0 THEN iou0 ELSE wf1 END AS ev,
  least(0.5, CASE WHEN tb = 0 AND pb > 0 THEN 0.2 ELSE 0 END + CASE WHEN pb = 15 THEN 0.2 ELSE 0 END + CASE WHEN coalesce(pa, 0) / 1e6 >= 0.8 THEN 0.2 ELSE 0 END + CASE WHEN len(ppos) / 50 >= 0.8 THEN 0.2 ELSE 0 END) AS pen
  FROM cs JOIN cw USING (kind)),
rw AS (SELECT id, kind, ok, CASE WHEN ok THEN w * (0.5 * v + 0.25 * t + 0.25 * ev) - pen ELSE -0.5 END AS reward, CASE WHEN ok THEN 0.5 * v + 0.25 * t + 0.25 * ev ELSE 0 END AS task, CASE WHEN ok THEN v ELSE 0 END AS v, CASE WHEN ok THEN t ELSE 0 END AS t, CASE WHEN ok THEN ev ELSE 0 END AS ev, CASE WHEN ok THEN pen ELSE 0.5 END AS pen FROM rv)"""


ANSWER_T, ANSWER_P = _json("tt", "tbox", "tpos"), _json("pt", "pbox", "ppos")
RENAMED = f"""'{{"label":"' || CASE WHEN pb = 0 THEN 'real' ELSE 'fake' END || '","badcase_types":"' || coalesce({_csv('pt')}, '') || '","evidence_bbox":' || CASE WHEN pbox IS NULL THEN 'null' ELSE '[' || {_csv('pbox')} || ']' END || ',"evidence_text_pos":[' || coalesce({_csv('ppos')}, '') || ']}}'"""
RESPONSE = f"CASE WHEN k % 7 = 0 THEN 'not json' WHEN k % 11 = 0 THEN '```json' || chr(10) || ({ANSWER_P}) || chr(10) || '```' WHEN k % 13 = 0 THEN 'The answer is ' || ({ANSWER_P}) || ' as asked.' WHEN k % 17 = 0 THEN {RENAMED} WHEN k % 19 = 0 THEN '{{\"verdict\":\"fake\",\"types\":[\"fs\"],\"image_bbox\":[9,9,1,1]}}' WHEN k % 23 = 0 THEN '{{\"verdict\":\"fake\",\"types\":[\"ts\"],\"text_positions\":[50]}}' ELSE {ANSWER_P} END"
CAPTION = "array_to_string(list_transform(range(1, n_words + 1), lambda i: 'w' || i), ' ')"
AUDIT = "Determine whether this image-text pair is pristine or manipulated. Return exactly one JSON object with keys verdict, types, image_bbox, and text_positions. verdict must be pristine or manipulated. types must be selected from [face_swap, face_attribute, text_swap, text_attribute]. image_bbox must be null or [x1,y1,x2,y2] normalized to 0-1000. text_positions must contain zero-based word indices in the normalized News text. Do not include markdown or extra explanation."
FRACTION = "(('0x' || substr(sha256('42:' || {key}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
GROUP = "CASE WHEN c % 5 <> 0 THEN 'n' || (c % 50) ELSE 'i' || k || '.png' END"
UID = """substr(sha1('{"fake_cls":"' || fake_cls || '","fake_image_box":[' || array_to_string(raw_box, ',') || '],"fake_text_pos":[' || array_to_string([k % 50, c % 50, (k + c) % 7], ',') || '],"id":' || CASE WHEN c % 5 <> 0 THEN '"n' || (c % 50) || '"' ELSE 'null' END
  || ',"image":"i' || k || '.png","index":' || k || ',"split":"train","text":"A-B/<person>,  says ' || k || '"}'), 1, 20)"""

def _official() -> str:
    word = WORD_ROWS + f", wm AS (SELECT {WORDS} FROM wd), gm AS (SELECT avg(iou) AS m, avg((iou > 0.5)::INT) AS i5, avg((iou > 0.75)::INT) AS i7, avg((iou > 0.95)::INT) AS i9, sum((label = predicted)::INT) / count(*) AS acc FROM wd)"
    sub = lambda name: "(SELECT * FROM (" + ORACLE_SQL[name] + "))"
    f1 = lambda t: f"(SELECT f1 FROM ({ORACLE_SQL['per_class_f1']}) WHERE type = '{t}')"
    mm = lambda c: f'(SELECT "{c}" FROM ({ORACLE_SQL["micro_macro_f1"]}))'
    parts = {"AUC_cls": sub("auc"), "ACC_cls": "(SELECT acc FROM gm)", "EER_cls": sub("eer"), "MAP": sub("mean_average_precision")} | {c.upper(): mm(c) for c in ("op", "or", "of1", "cp", "cr", "cf1")}
    parts |= {"F1_FS": f1("face_swap"), "F1_FA": f1("face_attribute"), "F1_TS": f1("text_swap"), "F1_TA": f1("text_attribute")}
    parts |= {"IOU_score": "(SELECT m FROM gm)", "IOU_ACC_50": "(SELECT i5 FROM gm)", "IOU_ACC_75": "(SELECT i7 FROM gm)", "IOU_ACC_95": "(SELECT i9 FROM gm)"}
    cells = {"ACC_tok": "(tp + tn) / (tp + tn + fp + fn)", "Precision_tok": "tp / (tp + fp)", "Recall_tok": "tp / (tp + fn)", "F1_tok": "2 * tp / (2 * tp + fp + fn)"}
    parts |= {k: f"(SELECT {v} FROM wm)" for k, v in cells.items()}
    return word + " " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({v} * 100.0, 4)::DOUBLE AS value" for k, v in parts.items())


#: Sub-words of a word: one for the first nine, whose names have two characters, else two.
HALVES = WORD_ROWS + ", hv AS (SELECT n_words + n_words - least(n_words, 9) AS n, list_sum(list_transform(list_intersect(tw, pw), lambda p: CASE WHEN p < 9 THEN 1 ELSE 2 END)) AS tp, list_sum(list_transform(tw, lambda p: CASE WHEN p < 9 THEN 1 ELSE 2 END)) AS t, list_sum(list_transform(pw, lambda p: CASE WHEN p < 9 THEN 1 ELSE 2 END)) AS p FROM wd)"

ORACLE_SQL = {
    "caption_normalize": rf"""
WITH l AS (SELECT doc_id, replace(replace(replace(regexp_replace(lower(text), '[,.''!?"()*#:;~]', '', 'g'), '-', ' '), '/', ' '), '<person>', 'person') AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '{WS}{{2,}}', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') AS t FROM l),
d AS (SELECT doc_id, array_to_string(string_split(t, ' ')[1:50], ' ') AS caption FROM s)
SELECT doc_id, caption, len(list_filter(string_split_regex(caption, '{WS}+'), lambda w: w <> ''))::INT AS n_words FROM d""",
    "build_target": BASE + f"SELECT id, CASE WHEN tb = 0 THEN 'pristine' ELSE 'manipulated' END AS verdict, coalesce({_csv('tt')}, '') AS types, {_csv('tbox')} AS box, coalesce({_csv('tpos')}, '') AS positions FROM a",
    "canonical_answer": BASE + f"SELECT id, {ANSWER_T} AS answer FROM a",
    "bbox_normalize": BASE
    + ", z AS (SELECT id, raw_box, c % 640 + 1 AS w, k % 480 + 1 AS h FROM a) SELECT id, "
    + ", ".join(f"round_even(least(1000.0, greatest(0.0, raw_box[{i + 1}]::DOUBLE / {'wh'[i % 2]} * 1000)), 0)::INT AS {n}" for i, n in enumerate(("x1", "y1", "x2", "y2")))
    + " FROM z",
    "prompts": BASE
    + f""", q AS (SELECT id, {CAPTION} AS cap FROM a) SELECT id, md5('<image>' || chr(10) || 'News text: ' || cap || chr(10) || '{AUDIT}') AS audit,
'News text: ' || cap || chr(10) || 'Decide whether the image-text pair is pristine or manipulated. Answer with exactly one word: pristine or manipulated.' AS judge,
'News text: ' || cap || chr(10) || 'Does this image-text pair contain a swapped text entity or phrase? Answer with exactly one word: yes or no.' AS third, cap AS stripped FROM q""",
    "sample_uid": BASE + f"SELECT id, {UID} AS uid FROM a",
    "convert_records": BASE
    + f"SELECT id, {UID} AS uid, CASE WHEN c % 5 <> 0 THEN 'n' || (c % 50) ELSE '' END AS news_id, CASE WHEN {FRACTION.format(key=GROUP)} < 0.1 THEN 'preference_pool' ELSE 'sft_train' END AS pool, 'a b person says ' || k AS caption, {ANSWER_T} AS answer, '/images/i' || k || '.png' AS image FROM a",
    "response_fields": BASE + f"SELECT id::VARCHAR AS id, CASE WHEN k % 4 IN (1, 2) THEN 'None' ELSE {RESPONSE} END AS response FROM a",
    "type_score_lists": BASE
    + "SELECT id, k % 4 < 2 AS has_types, "
    + ", ".join(f"round(CASE k % 4 WHEN 0 THEN {f'((k * {i + 2} + c) % 10007) / 10007.0' if i == 2 else 0} WHEN 1 THEN least(1.0, greatest(0.0, ((k * {i + 2} + c) % 10007) / 10007.0 * 2 - 0.5)) ELSE (ok AND pb & {1 << i} > 0)::INT END::DOUBLE, 6) AS s{i}" for i in range(4))
    + " FROM a",
    "score_vectors": BASE
    + "SELECT id, round(CASE WHEN k % 3 <> 0 THEN least(1.0, greatest(0.0, score * 2 - 0.5)) WHEN NOT ok THEN 0.5 ELSE (pb > 0)::INT END::DOUBLE, 6) AS score, k % 3 <> 0 AS given, "
    + ", ".join(f"round(CASE WHEN k % 4 <> 0 THEN ((k * {i + 2} + c) % 10007) / 10007.0 ELSE (ok AND pb & {1 << i} > 0)::INT END::DOUBLE, 6) AS s{i}" for i in range(4))
    + ", k % 4 <> 0 AS given_types FROM a",
    "json_path_numbers": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS value, try_cast(json_extract_string(props, '$.k') AS DOUBLE) * 100 AS percent FROM events",
    "comma_lists": "SELECT o_orderkey AS id, 'a' || o_orderkey || ',b' || CASE WHEN o_orderkey % 2 = 0 THEN ',' || o_custkey ELSE '' END AS items FROM orders",
    "image_dimensions": "SELECT o_orderkey AS id, (o_orderkey % 4000 + 1)::INT AS width, (o_custkey % 3000 + 1)::INT AS height FROM orders",
    "parse_response_rows": BASE
    + f"SELECT id, ok AS valid, CASE WHEN NOT ok THEN NULL WHEN pb = 0 THEN 'pristine' ELSE 'manipulated' END AS verdict, CASE WHEN ok THEN coalesce({_csv('pt')}, '') ELSE '' END AS types, CASE WHEN ok THEN {_csv('pbox')} END AS box, CASE WHEN ok THEN coalesce({_csv('ppos')}, '') ELSE '' END AS positions, CASE WHEN ok THEN NULL WHEN k % 7 = 0 THEN 'invalid_json' ELSE 'invalid_schema' END AS error FROM a",
    "json_lines_round_trip": BASE + f"SELECT id, fake_cls AS label, CASE WHEN tb = 0 THEN 'pristine' ELSE 'manipulated' END AS verdict, {_csv('tbox')} AS box FROM a",
    "split_union": BASE + "SELECT ['train', 'val', 'test'][id % 3 + 1] AS split, count(*) AS n, sum(id)::BIGINT AS ids, 0::BIGINT AS \"first\", count(*) - 1 AS \"last\", count(*) AS numbers, sum(length(fake_cls))::BIGINT AS letters FROM a GROUP BY 1",
    "array_records": BASE + "SELECT row_number() OVER (ORDER BY id) - 1 AS ord, id, fake_cls || '\"}],[{\\' AS label, 'none' AS third FROM a",
    "append_records": "SELECT count(*) AS n, count(*) AS ids, count(*) AS numbers, count(*) FILTER (o_orderkey % 2 = 0) AS \"first\", count(*) FILTER (o_orderkey % 2 = 0) AS first_again, count(*) FILTER (o_orderkey % 2 = 1) AS \"second\", count(*) FILTER (o_orderkey % 2 = 1) AS second_again FROM orders",
    "image_paths": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN '/x/i' ELSE '/x/data/i' END || o_orderkey || '.png' AS image_path, o_custkey AS width FROM orders",
    "trainer_rows": BASE + f"SELECT id, 'user' AS role, {CAPTION} AS content, 'i' || id AS image, CASE WHEN tb = 0 THEN 'pristine' ELSE 'manipulated' END AS verdict FROM a",
    "stable_split": f"SELECT doc_id, CASE WHEN {FRACTION.format(key='source')} < 0.2 THEN 'preference_pool' ELSE 'sft_train' END AS pool, round({FRACTION.format(key='source')}, 6) AS fraction FROM documents",
    "split_leak_check": " UNION ALL ".join(f"(SELECT '{by}' AS split_by, source FROM documents WHERE {FRACTION.format(key=by)} < 0.2 INTERSECT SELECT '{by}', source FROM documents WHERE NOT {FRACTION.format(key=by)} < 0.2)" for by in ("source", "doc_id")),
    "balanced_sample": BASE
    + """, v AS (SELECT id, CASE WHEN tb = 0 THEN 'pristine' ELSE 'manipulated' END AS verdict, sha256('42|' || id) AS h FROM a), n AS (SELECT count(*) FILTER (verdict = 'pristine') AS p, count(*) FILTER (verdict <> 'pristine') AS m FROM v),
t AS (SELECT p, m, least(floor(p / 0.4), floor(m / 0.6)) AS total FROM n), q AS (SELECT least(p, round_even(total * 0.4, 0)) AS qp, m, total FROM t), o AS (SELECT id, verdict, row_number() OVER (PARTITION BY verdict ORDER BY h, id) AS r FROM v)
SELECT id, verdict FROM o, q WHERE r <= CASE WHEN verdict = 'pristine' THEN qp ELSE least(m, total - qp) END""",
    "shuffled_head": BASE + "SELECT id, fake_cls AS label FROM a ORDER BY sha256('42|' || id), id LIMIT 500",
    "head_limit": BASE + "SELECT id, fake_cls AS label FROM a WHERE id < 1000",
    "shard_assign": "SELECT (o_orderkey % 7)::INT AS shard, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1",
    "shard_validate": "SELECT count(*) AS expected, count(*) AS rows, count(DISTINCT o_orderkey) AS unique_ids, count(*) = count(DISTINCT o_orderkey) AS ok FROM orders",
    "align_strict": BASE + f"SELECT id, {RESPONSE} AS response, fake_cls AS label FROM a",
    "align_positional": BASE + f"SELECT id, {RESPONSE} AS response FROM a",
    "resume_anti": BASE + "SELECT id, fake_cls AS label FROM a WHERE id % 3 <> 0",
    "leakage_guard": "SELECT o_orderkey AS id, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS allowed FROM orders",
    "bbox_iou": BASE + "SELECT id, round(CASE WHEN ok THEN iou0 WHEN tbox IS NULL THEN 1.0 ELSE 0.0 END, 6) AS iou, round(CASE WHEN ok THEN coalesce(pa, 0) ELSE 0 END / 1e6, 6) AS area FROM e",
    "set_f1": BASE + "SELECT id, round(CASE WHEN ok THEN wf1 WHEN len(tpos) = 0 THEN 1.0 ELSE 0.0 END, 6) AS f1 FROM e",
    "error_tags": BASE + f"SELECT id, coalesce({_csv('errors')}, '') AS errors FROM e",
    "error_tag_histogram": BASE + "SELECT tag, count(*) AS n FROM (SELECT unnest(errors) AS tag FROM e) GROUP BY tag",
    "bad_cases": BASE + "SELECT id, len(errors)::INT AS n FROM e WHERE len(errors) > 0",
    "binary_confusion": BASE
    + """, m AS (SELECT sum(label * predicted) AS tp, sum((1 - label) * (1 - predicted)) AS tn, sum((1 - label) * predicted) AS fp, sum(label * (1 - predicted)) AS fn FROM e)
SELECT tp::BIGINT AS tp, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS fpr, round(fn / (fn + tp), 6) AS fnr FROM m""",
    "generated_confusion": BASE
    + "SELECT count(*) FILTER (ok AND pb > 0 AND tb > 0) AS tp, count(*) FILTER (ok AND pb = 0 AND tb = 0) AS tn, count(*) FILTER ((NOT ok OR pb > 0) AND tb = 0) AS fp, count(*) FILTER ((NOT ok OR pb = 0) AND tb > 0) AS fn FROM e",
    "auc": BASE + ", rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM e), n AS (SELECT sum(label) AS p, count(*) - sum(label) AS q FROM e) SELECT round((sum(r) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)), 6) AS auc FROM rk, n",
    "eer": BASE
    + """, d AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM e GROUP BY score), t AS (SELECT sum(p) AS tp, sum(q) AS tq FROM d),
c AS (SELECT score, sum(q) OVER w / tq AS f, sum(p) OVER w / tp AS t FROM d, t WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
l AS (SELECT f, t, lag(f, 1, 0.0) OVER (ORDER BY score DESC) AS f0, lag(t, 1, 0.0) OVER (ORDER BY score DESC) AS t0 FROM c),
x AS (SELECT f, t, f0, 1 - t0 - f0 AS a, 1 - t - f AS b FROM l) SELECT round(arg_min(f0 + a / (a - b) * (f - f0), f), 6) AS eer FROM x WHERE a * b <= 0""",
    "average_precision": AP + " SELECT type, round(ap, 6) AS ap FROM ap",
    "mean_average_precision": AP + " SELECT round(avg(ap), 6) AS map FROM ap",
    "per_class_f1": CLASSES + " SELECT type, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr",
    "micro_macro_f1": CLASSES
    + ', mm AS (SELECT sum(tp) / sum(tp + fp) AS o, sum(tp) / sum(tp + fn) AS q, avg(p) AS cp, avg(r) AS cr FROM pr) SELECT round(o, 6) AS op, round(q, 6) AS "or", round(2 * o * q / (o + q), 6) AS of1, round(cp, 6) AS cp, round(cr, 6) AS cr, round(2 * cp * cr / (cp + cr), 6) AS cf1 FROM mm',
    "grounding_summary": WORD_ROWS
    + f"""SELECT count(*) AS num_samples, round(avg(ok::INT), 6) AS json_valid_rate, round(avg((ok AND (tb > 0) = (pb > 0))::INT), 6) AS verdict_accuracy, round(avg((ok AND tb = pb)::INT), 6) AS types_exact_match, round(avg(iou), 6) AS mean_iou,
round(avg((iou > 0.5)::INT), 6) AS iou_at_50, round(avg((iou > 0.75)::INT), 6) AS iou_at_75, round(avg((iou > 0.95)::INT), 6) AS iou_at_95, round(avg((len(errors) > 0)::INT), 6) AS badcase_rate,
round(avg((ok AND ((tb & 3 = 0 AND pbox IS NOT NULL) OR (tb & 12 = 0 AND len(ppos) > 0)))::INT), 6) AS evidence_hallucination_rate, {WORDS}, count(*) FILTER (len(errors) > 0) AS badcase_count, true AS all_scores, true AS all_types FROM wd""",
    "case_weights": CASES + ' SELECT kind AS "case", n, round(w, 6) AS weight FROM cw',
    "reward_breakdown": _reward("w") + ' SELECT id, round(reward, 6) AS reward, kind AS "case", round(task, 6) AS task_reward, round(v, 6)::DOUBLE AS verdict_reward, round(t, 6) AS type_reward, round(ev, 6) AS evidence_reward, round(pen, 6)::DOUBLE AS penalty, ok AS valid FROM rw',
    "reward_summary": _reward("w") + " SELECT count(*) AS count, round(avg(reward), 6) AS mean_reward, round(min(reward), 6) AS min_reward, round(max(reward), 6) AS max_reward, round(avg(pen), 6) AS mean_penalty, round(avg(ok::INT), 6) AS valid_rate FROM rw",
    "reward_callback": _reward("1.0") + " SELECT id, round(reward, 6) AS reward FROM rw",
    "preference_pairs": BASE + f"SELECT id, {ANSWER_T} AS chosen, {RESPONSE} AS rejected, {_csv('errors')} AS tags FROM e WHERE tb > 0 AND len(errors) > 0 ORDER BY sha256('42|' || id), id LIMIT 2000",
    "mining_report": BASE + "SELECT count(*) AS eligible, round(avg(ok::INT), 6) AS valid_prediction_rate, count(*) FILTER (len(errors) > 0) AS badcases FROM e WHERE tb > 0",
    "policy_prompts": "SELECT conv_id AS id, coalesce(min(struct_pack(n := turn, said := text)).said, '') AS prompt FROM conversations WHERE role = 'user' GROUP BY 1",
    "candidate_softmax": """WITH m AS (SELECT l_orderkey AS id, avg(-l_quantity / 10) FILTER (l_linenumber % 2 = 0) AS p, avg(-l_quantity / 10) FILTER (l_linenumber % 2 = 1) AS n FROM lineitem GROUP BY 1)
SELECT id, round(exp(p - greatest(n, p)) / (exp(n - greatest(n, p)) + exp(p - greatest(n, p))), 6) AS score FROM m""",
    "resume_predictions": BASE + "SELECT id::VARCHAR AS id, upper(fake_cls) AS response, 'generated_json_discrete_fallback' AS score_method FROM a WHERE id % 2 <> 0",
    "compare_runs": """WITH b AS (SELECT o_orderpriority AS metric, avg(((o_orderkey * 3) % 101) / 100.0) AS x, avg(((o_orderkey * 7) % 101) / 100.0) AS y FROM orders GROUP BY 1)
SELECT metric, CASE WHEN ok THEN round(x, 6) END AS before, CASE WHEN ok THEN round(y, 6) END AS after, CASE WHEN ok THEN round(y - x, 6) END AS absolute_delta, CASE WHEN ok THEN round(CASE WHEN up THEN (y - x) / (1 - x) ELSE (x - y) / x END, 6) END AS relative_error_reduction,
CASE WHEN ok THEN CASE WHEN up THEN 'higher' ELSE 'lower' END END AS direction, CASE WHEN ok THEN CASE WHEN up THEN y > x ELSE y < x END END AS improved FROM (SELECT *, metric < '3' AS up, metric <> '5-LOW' AS ok FROM b)""",
    "mean_logprobs": "SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'yes' ELSE 'no' END AS candidate, round(avg(-l_quantity / 10), 6) AS mean_logprob FROM lineitem GROUP BY 1, 2",
    "case_histogram": CASES + ' SELECT kind AS "case", n FROM cc',
    "pool_partition": f"SELECT CASE WHEN {FRACTION.format(key='(o_orderkey % 100)')} < 0.3 THEN 'preference_pool' ELSE 'sft_train' END AS pool, count(*) AS n, count(DISTINCT o_orderkey) AS ids, count(DISTINCT o_orderkey % 100) AS groups FROM orders GROUP BY 1",
    "comparison_summary": """WITH b AS (SELECT o_custkey % 500 AS m, round(avg(((o_orderkey * 3) % 101) / 100.0), 6) AS x, round(avg(((o_orderkey * 7) % 101) / 100.0), 6) AS y FROM orders GROUP BY 1)
SELECT count(*) AS compared_count, count(*) FILTER (CASE WHEN m % 2 = 0 THEN y > x ELSE y < x END) AS improved_count FROM b WHERE m <> 7""",
    "summarize_labels": BASE
    + "SELECT coalesce(fake_cls, '*') AS label, coalesce(v, '*') AS verdict, count(*) AS n FROM (SELECT fake_cls, CASE WHEN tb = 0 THEN 'pristine' ELSE 'manipulated' END AS v FROM a) GROUP BY GROUPING SETS ((fake_cls), (v), ())",
    "label_auc": """WITH s AS (SELECT (quality = 0 OR toxic = 1)::INT AS label, n_chars AS score FROM labels JOIN documents USING (doc_id)),
rk AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s), n AS (SELECT sum(label) AS p, count(*) - sum(label) AS q FROM s)
SELECT round((sum(r) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)), 6) AS auc FROM rk, n""",
}

ORACLE_SQL["subword_confusion"] = HALVES + "SELECT sum(coalesce(tp, 0))::BIGINT AS tp, sum(n - coalesce(t, 0) - coalesce(p, 0) + coalesce(tp, 0))::BIGINT AS tn, sum(coalesce(p, 0) - coalesce(tp, 0))::BIGINT AS fp, sum(coalesce(t, 0) - coalesce(tp, 0))::BIGINT AS fn FROM hv"
ORACLE_SQL["official_percent"] = _official()


def _softmax(prompt: str, negative: str, positive: str) -> str:
    """A stand-in's weights of two candidates after a prompt."""
    weight = lambda c: f"(-((length({prompt}) * {len(c)}) % 7) / 2.0)"
    return f"round(1 / (1 + exp({weight(negative)} - {weight(positive)})), 6)"


JUDGE = "('News text: ' || cap || chr(10) || 'Decide whether the image-text pair is pristine or manipulated. Answer with exactly one word: pristine or manipulated.')"
ABOUT = "('News text: ' || cap || chr(10) || 'Does this image-text pair contain {}? Answer with exactly one word: yes or no.')"
ORACLE_SQL["scored_predictions"] = BASE + (
    f", q AS (SELECT id, {CAPTION} AS cap FROM a) SELECT id, length(cap)::VARCHAR AS response, {_softmax(JUDGE, 'pristine', 'manipulated')} AS score, {_softmax(ABOUT.format('a face identity swap'), 'no', 'yes')} AS \"first\", "
    f"{_softmax(ABOUT.format('a manipulated textual attribute'), 'no', 'yes')} AS \"last\", 'length_normalized_sequence_likelihood' AS score_method FROM q"
)
#: Of the first 38 sub-words, how many are of the word numbered p.
PIECES = "greatest(0, least(CASE WHEN p < 9 THEN 1 ELSE 2 END, 38 - CASE WHEN p < 9 THEN p ELSE 2 * p - 9 END))"
ORACLE_SQL["word_pieces"] = WORD_ROWS + (
    ", hv AS (SELECT least(38, n_words + n_words - least(n_words, 9)) AS n, " + ", ".join(f"coalesce(list_sum(list_transform({xs}, lambda p: {PIECES})), 0) AS {name}" for xs, name in (("list_intersect(tw, pw)", "b"), ("tw", "t"), ("pw", "p"))) + " FROM wd)"
    ", m AS (SELECT sum(b) AS tp, sum(n - t - p + b) AS tn, sum(p - b) AS fp, sum(t - b) AS fn FROM hv) "
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, {c}::DOUBLE AS value FROM m" for c in ("tp", "tn", "fp", "fn")) + " UNION ALL SELECT 'f1_percent', round(100.0 * 2 * tp / (2 * tp + fp + fn), 4)::DOUBLE FROM m"
)
#: The tokenizer's file makes two sub-words of w1 to w9, the first nine words, and three of w10 and on.
TOKENS = "greatest(0, least(CASE WHEN p < 9 THEN 2 ELSE 3 END, 38 - CASE WHEN p < 9 THEN 2 * p ELSE 3 * p - 9 END))"
ORACLE_SQL["tokenizer_pieces"] = WORD_ROWS + (
    ", hv AS (SELECT least(38, 3 * n_words - least(n_words, 9)) AS n, " + ", ".join(f"coalesce(list_sum(list_transform({xs}, lambda p: {TOKENS})), 0) AS {name}" for xs, name in (("list_intersect(tw, pw)", "b"), ("tw", "t"), ("pw", "p"))) + " FROM wd)"
    " SELECT sum(b)::BIGINT AS tp, sum(n - t - p + b)::BIGINT AS tn, sum(p - b)::BIGINT AS fp, sum(t - b)::BIGINT AS fn FROM hv"
)
#: A customer's even (0) or odd (1) orders as a run.
RUNS = "WITH r AS (SELECT o_custkey AS run, o_orderkey % 2 AS odd, count(*) AS n, count(*) FILTER (o_totalprice > 150000) AS high, count(*) FILTER (o_orderpriority < '2') AS low FROM orders GROUP BY ALL) "
ORACLE_SQL["metric_tree"] = RUNS + " UNION ALL ".join(
    f"SELECT run, {m} AS metric, true AS higher, round({v}, 6)::DOUBLE AS value FROM r WHERE odd = 0 AND {w}"
    for m, v, w in (("'binary_auc'", "high / n", "true"), ("'binary_accuracy'", "n", "true"), ("'text_f1/official_bert_token'", "high", "run % 3 <> 0"), ("'text_f1/word_level_fallback'", "low", "run % 3 = 0"), ("'json_valid_rate'", "low / 10", "low > 0"), ("'face_swap_f1'", "0.5", "true"))
) + " UNION ALL SELECT run, 'binary_eer', false, round(low / n, 6)::DOUBLE FROM r WHERE odd = 0"


def _report(name: str, value: str, best: str, better: str) -> str:
    a, b = value.format(r="a"), value.format(r="b")
    number = lambda v, style: f"format('{{:{style}}}', ({v})::DOUBLE)"
    gone = f"CASE WHEN {a} = {best} THEN 'N/A' ELSE " + number(f"100 * (({b} - {a}) / ({best} - {a}))", ".2f") + " || '%' END"
    cells = [f"'{name}'", number(a, ".6f"), number(b, ".6f"), number(f"{b} - {a}", "+.6f"), f"CASE WHEN {b} {better} {a} THEN 'yes' ELSE 'no' END", gone]
    return "SELECT a.run, '| ' || " + " || ' | ' || ".join(cells) + " || ' |' AS line FROM r a JOIN r b ON a.run = b.run AND a.odd = 0 AND b.odd = 1"


ORACLE_SQL["report_rows"] = RUNS + _report("binary_auc", "{r}.high / {r}.n", "1", ">") + " UNION ALL " + _report("binary_eer", "{r}.low / {r}.n", "0", "<")
ORACLE_SQL["registry_entries"] = "SELECT 'p_' || d AS name, 'p_' || d || '.jsonl' AS file_name, 'sharegpt' AS formatting, d LIKE '%badcase%' AS ranking, CASE WHEN d LIKE '%badcase%' THEN 'chosen,images,messages,rejected' ELSE 'images,messages' END AS columns, n FROM (VALUES (0, 'sft_train'), (1, 'preference_pool'), (2, 'val'), (3, 'test'), (4, 'badcase_preference'), (5, 'base_badcase_preference')) t(i, d) JOIN (SELECT o_orderkey % 6 AS i, count(*) AS n FROM orders GROUP BY 1) USING (i)"
ORACLE_SQL["auc_sketch"] = BASE + (
    ", sk AS (SELECT least(floor(score * 256), 255) AS b, count(*) FILTER (tb > 0) AS p, count(*) FILTER (tb = 0) AS n FROM a GROUP BY 1), sb AS (SELECT *, sum(n) OVER (ORDER BY b) - n AS below FROM sk)"
    " SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6)::DOUBLE AS auc, round(sum(p * n) / 2 / (sum(p) * sum(n)), 6)::DOUBLE AS error, true AS within FROM sb"
)
