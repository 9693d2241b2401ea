"""Parts of the DuckDB twins that several modules use: the adapters' tables as common table expressions."""

SCORES = """scores AS (
  SELECT l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS clip_id,
         min(l_discount * 10) AS hubert_wer, min(l_tax * 10) AS whisper_wer, min(l_quantity / 50) AS w2v2_wer
  FROM lineitem GROUP BY 1)"""
#: The place of the least score, which is the first of equals; no score is null here.
LABEL = "CAST(list_position([hubert_wer, whisper_wer, w2v2_wer], least(hubert_wer, whisper_wer, w2v2_wer)) - 1 AS INTEGER)"
LABELLED = f"""{SCORES},
labelled AS (SELECT *, {LABEL} AS label, least(hubert_wer, whisper_wer, w2v2_wer) AS best FROM scores)"""
SPLIT = f"""{LABELLED},
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', clip_id)), clip_id) AS rn, count(*) OVER () AS n_total FROM labelled),
split AS (SELECT *, CASE WHEN rn <= floor(n_total * CAST(0.8 AS DOUBLE)) THEN 'train'
                         WHEN rn <= floor(n_total * CAST(0.8 AS DOUBLE)) + floor(n_total * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split,
          CAST(('0x' || substr(md5(concat('42:', clip_id)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
          FROM ranked)"""
STEPS = """steps AS (SELECT user_id % 3 AS run, event_type AS tag, value,
          row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY ts, event_id) AS step FROM events)"""
FRAMES = """frames AS (SELECT CAST(label AS BIGINT) AS clip_id, vec_id, embedding,
           row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"""
