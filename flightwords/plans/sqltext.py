"""SQL text of the derived recorder tables, for the result checks.

Written against the given tables only and independently of the DataFrame code:
segments are joined and summed here, folded there.
"""

from __future__ import annotations

from ..schemas import SYNC_WORDS
from .bridge import MAPPING, PART_TYPES

SUB = """
sub AS (
  SELECT CAST(o_orderkey // 512 AS VARCHAR) AS rec, o_orderkey AS seq, o_orderkey // 4 AS fi,
         CAST(o_orderkey % 4 + 1 AS INT) AS sf,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'MISSING'
              WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'INVALID'
              ELSE 'RECEIVED' END AS state,
         1.7e9 + o_orderkey AS t_end, CAST(floor(o_totalprice * 100) AS BIGINT) AS c
  FROM orders)
"""


def word_of(word: str, c: str = "c", sf: str = "sf") -> str:
    sync = "[" + ",".join(map(str, SYNC_WORDS)) + "]"
    return f"(CASE WHEN {word} = 1 THEN {sync}[{sf}] ELSE ({c} + {word} * 131) % 4096 END)"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(str, v)) + "]"
    return str(v)


def _values(name: str, cols: str, rows) -> str:
    body = ",\n    ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"{name}({cols}) AS (VALUES\n    {body})"


PAR = _values(
    "par", "ord, pid, name, descr, ptype, unit, lo, hi, res, off_, formula, tlab, flab",
    [(i, p["pid"], p["name"], p["description"], p["ptype"], p["unit"], p["lo"], p["hi"], p["res"], p["off"],
      p["formula"], p["true"], p["false"]) for i, p in enumerate(MAPPING, 1)],
)
SEG = _values(
    "seg", "pid, occ, seq, sfs, word, lsb, msb, wt",
    [row for p in MAPPING for o, segs in enumerate(p["occs"], 1) for row in (
        [(p["pid"], o, s, list(g[0]), *g[1:]) for s, g in enumerate(segs, 1)] or [(p["pid"], o, *[None] * 6)]
    )],
)
ST = _values("st", "pid, value, label", [(p["pid"], v, lab) for p in MAPPING for v, lab in p["states"]])



def cells_sql(*pids: str) -> str:
    """VALUES (pid, sfs, word, lo_, width, shift) of every segment of some parameters."""
    rows = []
    for p in MAPPING:
        for segs in p["occs"] if p["pid"] in pids else []:
            widths = [abs(g[3] - g[2]) + 1 for g in segs]
            rows += [(p["pid"], list(g[0]), g[1], min(g[2], g[3]), w, sum(widths[k + 1 :])) for k, (g, w) in enumerate(zip(segs, widths))]
    return "VALUES " + ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)


MAP = f"""
{PAR},
{SEG},
{ST},
segx AS (
  SELECT *, least(lsb, msb) AS lo_, abs(msb - lsb) + 1 AS width,
         NOT (lsb BETWEEN 1 AND 12 AND msb BETWEEN 1 AND 12 AND word BETWEEN 1 AND 64) AS bad
  FROM seg WHERE seq IS NOT NULL),
segs AS (
  SELECT *, CAST(coalesce(sum(width) OVER (PARTITION BY pid, occ ORDER BY seq
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS shift
  FROM segx),
occs AS (
  SELECT p.ord, p.pid, coalesce(g.occ, 0) AS occ,
         CASE WHEN max(g.occ) IS NULL THEN 'parameter has no occurrences'
              WHEN count(g.seq) = 0 THEN 'occurrence has no segments'
              WHEN count(DISTINCT g.sfs) > 1 THEN 'segments disagree on subframes' END AS err,
         any_value(g.sfs) AS sfs, min(x.seq) FILTER (WHERE x.bad) AS bad_seq,
         CAST(sum(x.width) AS BIGINT) AS width
  FROM par p LEFT JOIN seg g ON g.pid = p.pid LEFT JOIN segx x ON x.pid = g.pid AND x.occ = g.occ AND x.seq = g.seq
  GROUP BY p.ord, p.pid, g.occ),
occx AS (
  SELECT o.*, (SELECT min(word) FROM segx x WHERE x.pid = o.pid AND x.occ = o.occ
               AND (o.bad_seq IS NULL OR x.seq <= o.bad_seq)) AS first_word
  FROM occs o)
"""

_FIELD = f"((({word_of('g.word', 's.c', 's.sf')}) >> (g.lo_ - 1)) & ((1 << g.width) - 1))"

# Decoded samples: smp(rec, seq, fi, sf, ord, pid, name, occ, t, bits, raw, decoded, eng, label, unit, status)
SMP = f"""
{SUB},
{MAP},
ext AS (
  SELECT s.rec, s.seq, s.fi, s.sf, s.t_end, o.ord, o.pid, o.occ, o.width, o.first_word, g.seq AS gseq, g.wt,
         {_FIELD} AS part, g.shift
  FROM sub s JOIN occx o ON list_contains(o.sfs, s.sf) AND o.err IS NULL AND o.bad_seq IS NULL
  JOIN segs g ON g.pid = o.pid AND g.occ = o.occ
  WHERE s.state = 'RECEIVED'),
asm AS (
  SELECT rec, seq, fi, sf, t_end, ord, pid, occ, width, first_word,
         CAST(sum(part << shift) AS BIGINT) AS raw, bool_and(wt IS NOT NULL) AS weighted, bool_or(part > 9) AS digit_bad,
         0.0::DOUBLE + coalesce(max(part * wt) FILTER (WHERE gseq = 1), 0.0::DOUBLE)
           + coalesce(max(part * wt) FILTER (WHERE gseq = 2), 0.0::DOUBLE)
           + coalesce(max(part * wt) FILTER (WHERE gseq = 3), 0.0::DOUBLE) AS wsum
  FROM ext GROUP BY ALL),
dec AS (
  SELECT a.*, p.* EXCLUDE (ord, pid),
         CASE WHEN p.formula <> 'linear' AND p.ptype IN ('analog_signed', 'analog_unsigned', 'bcd') THEN NULL
              WHEN p.ptype = 'analog_signed' THEN CASE WHEN raw >= (1::BIGINT << (width - 1)) THEN raw - (1::BIGINT << width) ELSE raw END::DOUBLE
              WHEN p.ptype IN ('analog_unsigned', 'raw', 'discrete') THEN raw::DOUBLE
              WHEN p.ptype = 'bcd' AND weighted THEN CASE WHEN NOT digit_bad THEN round(wsum, 10) END
              WHEN p.ptype = 'bcd' THEN CASE WHEN (raw & 15) <= 9 AND ((raw >> 4) & 15) <= 9 AND ((raw >> 8) & 15) <= 9
                THEN ((raw & 15) + 10 * ((raw >> 4) & 15) + 100 * ((raw >> 8) & 15))::DOUBLE END
         END AS decoded
  FROM asm a JOIN par p ON p.pid = a.pid),
val AS (
  SELECT d.*,
         CASE WHEN ptype IN ('analog_signed', 'analog_unsigned', 'bcd') THEN decoded * res + off_
              WHEN ptype = 'raw' THEN decoded END AS eng,
         CASE WHEN ptype = 'discrete' THEN coalesce(nullif(st.label, ''),
              CASE WHEN raw <> 0 THEN coalesce(tlab, 'TRUE') ELSE coalesce(flab, 'FALSE') END) END AS label
  FROM dec d LEFT JOIN st ON st.pid = d.pid AND st.value = d.raw),
smp AS (
  SELECT rec, seq, fi, sf, ord, pid, name, descr, ptype, occ, (t_end - 1.0) + (first_word - 1) / 64.0 AS t,
         lpad(bin(raw), width::INT, '0') AS bits, raw, decoded, eng, label,
         CASE WHEN ptype <> 'discrete' THEN unit END AS unit,
         CASE WHEN ptype = 'unknown' THEN 'UNSUPPORTED_TYPE'
              WHEN formula <> 'linear' AND ptype IN ('analog_signed', 'analog_unsigned', 'bcd') THEN 'UNSUPPORTED_TYPE'
              WHEN ptype = 'bcd' AND decoded IS NULL THEN 'INVALID_BCD'
              WHEN eng < lo THEN 'OUT_OF_RANGE' WHEN eng > hi THEN 'OUT_OF_RANGE' ELSE 'VALID' END AS status
  FROM val
  UNION ALL
  SELECT s.rec, s.seq, s.fi, CASE WHEN o.err IS NULL THEN s.sf END, o.ord, o.pid, p.name, p.descr, p.ptype, o.occ,
         (s.t_end - 1.0) + (CASE WHEN o.err IS NULL THEN o.first_word ELSE 1 END - 1) / 64.0,
         NULL, NULL, NULL, NULL, NULL, p.unit, 'INVALID_MAPPING'
  FROM sub s JOIN occx o ON (o.err IS NOT NULL AND s.sf = 1)
                         OR (o.err IS NULL AND o.bad_seq IS NOT NULL AND list_contains(o.sfs, s.sf))
  JOIN par p ON p.pid = o.pid
  WHERE s.state = 'RECEIVED')
"""

# Stored points: pts(rec, pid, name, unit, seq, occ, t, value)
PTS = f"""
{SMP},
pts AS (
  SELECT rec, pid, name, unit, seq, occ, t, coalesce(eng, decoded) AS value
  FROM smp WHERE coalesce(eng, decoded) IS NOT NULL)
"""

TYPE_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PART_TYPES.items()) + " ELSE 'odd' END"

# Mapping documents made of parts: pdoc, ppar, pseg.
PART = f"""
ppar AS (
  SELECT 'D' || CAST(p_partkey // 64 AS VARCHAR) AS doc, CAST(p_partkey % 64 + 1 AS BIGINT) AS ord,
         'part-' || CAST(p_partkey AS VARCHAR) AS pid, upper(p_name) AS mnemonic, p_brand || ' ' || p_type AS descr,
         p_type AS source_type, {TYPE_CASE} AS ptype, split_part(p_name, ' ', 2) AS unit,
         CAST(p_size - 10 AS DOUBLE) AS lo, CASE WHEN p_size <> 50 THEN CAST(40 - p_size AS DOUBLE) END AS hi,
         CASE WHEN p_size = 13 THEN 0.0::DOUBLE ELSE p_size / 8.0 END AS res, CAST(p_size - 25 AS DOUBLE) AS off_,
         CASE WHEN p_size = 7 THEN 'table' ELSE 'linear' END AS formula,
         CASE WHEN p_size > 30 THEN 'ON' END AS tlab, p_size, p_partkey
  FROM part),
pseg AS (
  SELECT doc, ord, pid, mnemonic, 1 AS seq, CAST(p_partkey % 4 + 1 AS INT) AS sf, p_size AS word,
         CAST(CAST(floor(p_retailprice * 100) AS BIGINT) % 13 AS INT) AS lsb,
         least(CAST(CAST(floor(p_retailprice * 100) AS BIGINT) % 13 AS INT) + 3, 12) AS msb, 1 AS listed
  FROM ppar JOIN (SELECT p_partkey AS k, p_retailprice FROM part) ON k = p_partkey WHERE p_size <> 3
  UNION ALL
  SELECT doc, ord, pid, mnemonic, CASE WHEN p_size > 45 THEN 1 ELSE 2 END,
         CAST((p_partkey + CASE WHEN p_size > 40 THEN 1 ELSE 0 END) % 4 + 1 AS INT), p_size + 3, 1, 8, 2
  FROM ppar WHERE p_size > 20),
pdoc AS (
  SELECT 'D' || CAST(p_partkey // 64 AS VARCHAR) AS doc, CASE WHEN max(p_size) < 50 THEN 0 ELSE 48 END AS wps,
         CASE WHEN count(*) = 64 THEN [583, 1464, 2631, 3512] ELSE [583, 5000, 2631] END AS sync
  FROM part GROUP BY 1)
"""
