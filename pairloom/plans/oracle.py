"""DuckDB SQL of the read operators, in parts that the queries' SQL is put together from.

Each part is common table expressions over named inputs. Dynamic programmes are written as set operations where these
say the same (the longest common substring is the longest run of a diagonal) and as recursion where they don't.
"""

from __future__ import annotations

from collections.abc import Sequence

_LUT = "CAST(least(41, floor(0.5 - 10 * log10({}))) AS INTEGER)"
SAME = _LUT.format("a * b / ((1 - a) * (1 - b) + a * b)")
OTHER = _LUT.format("a / (a + b - a * b)")
ERRORS = "power(10, -greatest(x, y) / 12.0) AS a, power(10, -least(x, y) / 12.0) AS b"


def rc(c: str) -> str:
    return f"reverse(translate({c}, 'ACGT', 'TGCA'))"


def display(c: str) -> str:
    head = f"split_part({c}, ' ', 1)"
    tail = f"array_to_string(list_slice(string_split({head}, ':'), 5, 1000), ':')"
    return f"CASE WHEN length({tail}) > 0 THEN regexp_replace({tail}, '[^0-9]', '_', 'g') ELSE substr({head}, 2) END"


CLEAN = """
clean AS (
  SELECT ordinal, job_id, read_name_first AS name, upper(readseq_first) AS seq, quality_first AS qual, forward_primer AS vprimer, reverse_primer AS cprimer,
         forward_barcode AS fbarcode, reverse_barcode AS rbarcode
  FROM read_pair
  WHERE regexp_full_match(upper(readseq_first), '[ACGTN]+') AND regexp_full_match(quality_first, '[!-J]+') AND length(readseq_first) = length(quality_first) AND read_name_first IS NOT NULL)
"""

#: Primers, the windows of their search, and the turned primer of each.
PRIMERS = f"""
pr AS (SELECT primer_id, rtrim(primer_name) AS name, upper(seq) AS seq, primer_role AS role, orient, barcode_len FROM primers),
pk AS (SELECT primer_id, role, orient, substr(seq, k, 5) AS g FROM pr, unnest(range(1, length(seq) - 3)) AS u(k)),
pc AS (
  SELECT max(length(seq) + barcode_len) FILTER (role = 'F') AS foff, min(barcode_len) FILTER (role = 'F') AS fmin,
         max(length(seq) + barcode_len) FILTER (role = 'R') AS roff, min(barcode_len) FILTER (role = 'R') AS rmin FROM pr WHERE orient = 'fwd'),
flip AS (SELECT a.primer_id, b.primer_id AS other FROM pr a JOIN pr b ON a.role = b.role AND a.name = b.name AND a.orient <> b.orient AND {rc("a.seq")} = b.seq)
"""


def well_formed(src: str = "read_pair", least: str = "1") -> str:
    """``p``: pairs whose reads have legal qualities of their own length and ``least`` bases."""
    return f"""
p AS (
  SELECT ordinal, job_id, read_name_first AS name1, upper(readseq_first) AS seq1, quality_first AS qual1, upper(readseq_second) AS seq2, quality_second AS qual2, {rc("upper(readseq_second)")} AS rc2
  FROM {src}
  WHERE length(readseq_first) = length(quality_first) AND length(readseq_second) = length(quality_second) AND least(length(readseq_first), length(readseq_second)) >= greatest(1, {least})
    AND regexp_full_match(quality_first, '[!-J]*') AND regexp_full_match(quality_second, '[!-J]*'))
"""


#: ``lcs``: the longest common substring of the first read and the second in both directions, by runs along diagonals: of
#: common 4-mers, and of single characters where the reads share none. Places from 0; pairs without any are left out.
LCS = """
dirs AS (SELECT ordinal, 'f' AS dir, seq1, seq2 AS z FROM p UNION ALL SELECT ordinal, 'r', seq1, rc2 FROM p),
kx AS (SELECT ordinal, i, substr(seq1, i, 4) AS g FROM p, unnest(range(1, length(seq1) - 2)) AS u(i)),
ky AS (SELECT ordinal, dir, j, substr(z, j, 4) AS g FROM dirs, unnest(range(1, length(z) - 2)) AS u(j)),
m4 AS (SELECT ordinal, dir, i, j, i - row_number() OVER (PARTITION BY ordinal, dir, i - j ORDER BY i) AS isl FROM kx JOIN ky USING (ordinal, g)),
r4 AS (SELECT ordinal, dir, min(i) AS x, min(j) AS y, count(*) + 3 AS len FROM m4 GROUP BY ordinal, dir, i - j, isl),
m1 AS (
  SELECT ordinal, dir, i, j, i - row_number() OVER (PARTITION BY ordinal, dir, i - j ORDER BY i) AS isl
  FROM dirs ANTI JOIN r4 USING (ordinal, dir), unnest(range(1, length(seq1) + 1)) AS u(i), unnest(range(1, length(z) + 1)) AS v(j) WHERE substr(seq1, i, 1) = substr(z, j, 1)),
r1 AS (SELECT ordinal, dir, min(i) AS x, min(j) AS y, count(*) AS len FROM m1 GROUP BY ordinal, dir, i - j, isl),
lcs AS (
  SELECT ordinal, dir, x - 1 AS x, y - 1 AS y, len FROM (FROM r4 UNION ALL FROM r1)
  QUALIFY row_number() OVER (PARTITION BY ordinal, dir ORDER BY len DESC, y + len, x) = 1)
"""

#: ``w``: pairs turned and set side by side where they overlap; ``c``: the positions of the overlaps.
WINDOW = """
ori AS (
  SELECT p.*, CASE WHEN r.len >= f.len THEN rc2 ELSE seq2 END AS q, CASE WHEN r.len >= f.len THEN reverse(qual2) ELSE qual2 END AS qq,
         CASE WHEN r.len >= f.len THEN r.x ELSE f.x END AS ri, CASE WHEN r.len >= f.len THEN r.y ELSE f.y END AS qi
  FROM p JOIN lcs f ON f.ordinal = p.ordinal AND f.dir = 'f' JOIN lcs r ON r.ordinal = p.ordinal AND r.dir = 'r'),
w AS (SELECT *, ri - least(ri, qi) AS ref_start, qi - least(ri, qi) AS read_start, least(ri, qi) + least(length(seq1) - ri, length(q) - qi) AS overlap FROM ori),
c AS (
  SELECT ordinal, i, substr(seq1, ref_start + i, 1) AS b1, ascii(substr(qual1, ref_start + i, 1)) - 33 AS x, substr(q, read_start + i, 1) AS b2, ascii(substr(qq, read_start + i, 1)) - 33 AS y
  FROM w, unnest(range(1, overlap + 1)) AS u(i))
"""


def merged(cells: str = "c") -> str:
    """``g``: bases and qualities of the merged overlaps; pairs with N in both reads somewhere are left out."""
    return f"""
e AS (SELECT *, {ERRORS} FROM {cells}),
m AS (
  SELECT ordinal, i,
    CASE WHEN b1 = 'N' THEN b2 WHEN b2 = 'N' THEN b1 WHEN b1 = b2 THEN b1 WHEN x = y THEN greatest(b1, b2) WHEN x > y THEN b1 ELSE b2 END AS b,
    CASE WHEN b1 = 'N' THEN y WHEN b2 = 'N' THEN x WHEN b1 <> b2 AND x = y THEN x WHEN x = 0 THEN y WHEN y = 0 THEN x WHEN b1 = b2 THEN {SAME} ELSE {OTHER} END AS q
  FROM e),
g AS (SELECT ordinal, string_agg(b, '' ORDER BY i) AS seq, string_agg(chr(q + 33), '' ORDER BY i) AS qual FROM m GROUP BY 1 HAVING count_if(b = 'N') = 0)
"""


#: ``win``: the windows of the overlaps with their qualities, and their identity.
WINDOWS = """
win AS (SELECT ordinal, substr(seq1, ref_start + 1, overlap) AS wx, substr(qual1, ref_start + 1, overlap) AS wxq, substr(q, read_start + 1, overlap) AS wy, substr(qq, read_start + 1, overlap) AS wyq FROM w),
iden AS (SELECT ordinal, 100.0 * count_if(b1 = b2) / count(*) AS identity FROM c GROUP BY 1)
"""


def realigned(least: float, gap: int = 9) -> str:
    """``loc``: the windows of less than ``least`` % identity, aligned locally and padded to cover them whole."""
    i, j = "(d + 1 + h) // 2", "(d + 1 - h) // 2"
    same = f"substr(x, {i}, 1) = substr(y, {j}, 1)"
    spread = "string_agg(CASE WHEN substr({0}, pos, 1) = '-' THEN '!' ELSE substr({1}, CAST(length(replace(left({0}, pos), '-', '')) AS BIGINT), 1) END, '' ORDER BY pos)"
    return f"""
poor AS (SELECT win.* FROM win JOIN iden USING (ordinal) WHERE identity < {least}),
sw_in AS (SELECT DISTINCT wx AS x, wy AS y, length(wx) AS n FROM poor),
sw(x, y, n, d, s, b) USING KEY (x, y) AS (
  SELECT x, y, n, 0, list_transform(range(-n, n + 1), lambda h: {{'c': 0, 'k': 2, 'p': ''}}), {{'c': 0, 'i': 0::BIGINT, 'j': 0::BIGINT, 'p': ''}} FROM sw_in
  UNION
  SELECT x, y, n, d, s, list_max(list_append(list_transform(s, lambda e, t: CASE WHEN NOT v[t].skip AND v[t].i > 0 AND v[t].j > 0 THEN {{'c': e.c, 'i': -v[t].i, 'j': -v[t].j, 'p': e.p}} ELSE b END), b))
  FROM (
    SELECT x, y, n, d, b, v, list_transform(v, lambda w, t: CASE
      WHEN w.skip THEN s[t]
      WHEN w.i = 0 THEN {{'c': 0, 'k': 2, 'p': ''}} WHEN w.j = 0 THEN {{'c': 0, 'k': 1, 'p': ''}}
      WHEN w.a >= w.u AND w.a >= w.l THEN {{'c': w.a, 'k': 0, 'p': CASE WHEN w.a > 0 THEN s[t].p || 'M' ELSE '' END}}
      WHEN w.u >= w.l THEN {{'c': w.u, 'k': 1, 'p': s[t - 1].p || 'D'}} ELSE {{'c': w.l, 'k': 2, 'p': s[t + 1].p || 'I'}} END) AS s
    FROM (
      SELECT x, y, n, d + 1 AS d, s, b, list_transform(range(-n, n + 1), lambda h, t: {{
        'i': {i}, 'j': {j}, 'skip': (d + 1 + h) % 2 <> 0 OR d + 1 + h < 0 OR d + 1 - h < 0 OR {i} > n OR {j} > n,
        'a': greatest(0, s[t].c + CASE WHEN {same} THEN 5 ELSE -4 END),
        'u': CASE WHEN t > 1 THEN s[t - 1].c - {gap} - 2 * (s[t - 1].k = 0)::INT ELSE -1000 END,
        'l': CASE WHEN t <= 2 * n THEN s[t + 1].c - {gap} - 2 * (s[t + 1].k = 0)::INT ELSE -1000 END}}) AS v
      FROM sw WHERE d < 2 * n))),
ends AS (
  SELECT x, y, n, b.p AS ops, -b.i AS i1, -b.j AS j1, -b.i - length(replace(b.p, 'I', '')) AS i0, -b.j - length(replace(b.p, 'D', '')) AS j0 FROM sw),
mid AS (
  SELECT x, y, string_agg(CASE substr(ops, pos, 1) WHEN 'I' THEN '-' ELSE substr(x, i0 + length(replace(left(ops, pos), 'I', '')), 1) END, '' ORDER BY pos) AS gx,
         string_agg(CASE substr(ops, pos, 1) WHEN 'D' THEN '-' ELSE substr(y, j0 + length(replace(left(ops, pos), 'D', '')), 1) END, '' ORDER BY pos) AS gy FROM ends, unnest(range(1, length(ops) + 1)) AS u(pos) GROUP BY ALL),
padded AS (
  SELECT x, y, left(x, i0 - lead) || repeat('-', j0 - lead) || substr(x, i0 - lead + 1, lead) || coalesce(gx, '') || substr(x, i1 + 1) || repeat('-', n - j1 - tail) AS gx,
         repeat('-', i0 - lead) || left(y, j0 - lead) || substr(y, j0 - lead + 1, lead) || coalesce(gy, '') || substr(y, j1 + 1, tail) || repeat('-', n - i1 - tail) || substr(y, j1 + tail + 1) AS gy
  FROM (SELECT *, least(i0, j0) AS lead, least(n - i1, n - j1) AS tail FROM ends) LEFT JOIN mid USING (x, y)),
loc AS (
  SELECT ordinal, any_value(gx) AS wx, any_value(gy) AS wy, {spread.format("gx", "wxq")} AS wxq, {spread.format("gy", "wyq")} AS wyq
  FROM poor JOIN padded ON x = wx AND y = wy, unnest(range(1, length(gx) + 1)) AS u(pos) GROUP BY ordinal)"""


#: ``lc``: the positions of the overlaps after local realignment, gaps as N of quality 0.
REALIGNED = """
lc AS (
  SELECT ordinal, i, replace(substr(wx, i, 1), '-', 'N') AS b1, ascii(substr(wxq, i, 1)) - 33 AS x, replace(substr(wy, i, 1), '-', 'N') AS b2, ascii(substr(wyq, i, 1)) - 33 AS y
  FROM (SELECT ordinal, wx, wxq, wy, wyq FROM win ANTI JOIN loc USING (ordinal) UNION ALL SELECT ordinal, wx, wxq, wy, wyq FROM loc), unnest(range(1, length(wx) + 1)) AS u(i))
"""


def _stitched(c: str, one: str, two: str) -> str:
    a = f"left({one}, ref_start) || g.{c} || substr(w.{two}, read_start + overlap + 1)"
    return f"CASE WHEN ref_start >= read_start THEN {a} ELSE left(w.{two}, read_start) || g.{c} || substr({one}, ref_start + overlap + 1) END AS {c}"


#: ``st``: merged pairs.
STITCHED = f"st AS (SELECT ordinal, job_id, name1, {_stitched('seq', 'seq1', 'q')}, {_stitched('qual', 'qual1', 'qq')} FROM g JOIN w USING (ordinal))"


def merge(least: str = "1", src: str = "read_pair") -> str:
    """All of the above, up to ``st``."""
    return ", ".join([well_formed(src, least), LCS, WINDOW, merged(), STITCHED])


def subsequence(x: str, y: str) -> str:
    """Length of the longest common subsequence of two strings, y of up to 60 letters: the bits of a number are its row."""
    full = f"((1::BIGINT << length({y})) - 1)"
    masks = f"list_transform(string_split({x}, ''), lambda ch: list_sum(list_transform(range(1, length({y}) + 1), lambda k: CASE WHEN substr({y}, k, 1) = ch THEN 1::BIGINT << (k - 1) ELSE 0 END))::BIGINT)"
    row = f"list_reduce({masks}, lambda r, h: ((r + (r & h)) | (r - (r & h))) & {full}, {full})"
    return f"CAST(CASE WHEN length({x}) = 0 OR length({y}) = 0 THEN 0 ELSE length({y}) - bit_count({row}) END AS INTEGER)"


def approximate(name: str, src: str, role: str, orient: str) -> str:
    """``name``: for each row of ``src`` (``ordinal``, ``w``) the primer that the window holds approximately, or null, and
    the length of the longest common substring with any of the primers."""
    mine = f"role = '{role}' AND orient = '{orient}'"
    return f"""
{name}_m AS (
  SELECT ordinal, primer_id, i, j, i - row_number() OVER (PARTITION BY ordinal, primer_id, i - j ORDER BY i) AS isl
  FROM {src}, pr, unnest(range(1, length(seq) + 1)) AS u(i), unnest(range(1, length(w) + 1)) AS v(j) WHERE {mine} AND substr(seq, i, 1) = substr(w, j, 1)),
{name}_r AS (SELECT ordinal, primer_id, min(i) AS x, min(j) AS y, count(*) AS len FROM {name}_m GROUP BY ordinal, primer_id, i - j, isl),
{name}_b AS (SELECT ordinal, y, len FROM {name}_r QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY len DESC, primer_id, y + len, x) = 1),
{name}_v AS (
  SELECT ordinal, primer_id, count(*) AS votes FROM {name}_b JOIN {src} USING (ordinal), unnest(range(y, y + len - 4)) AS u(k), pk
  WHERE {mine} AND len > 5 AND g = substr(w, k, 5) GROUP BY ALL),
{name}_c AS (SELECT ordinal, primer_id FROM {name}_v QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY votes DESC, primer_id) = 1),
{name} AS (
  SELECT b.ordinal, b.len AS lcs, CASE WHEN 100.0 * b.len / length(seq) > 90 OR 100.0 * {subsequence("seq", "w")} / length(seq) > 80 THEN primer_id END AS primer_id
  FROM {name}_b b JOIN {src} USING (ordinal) LEFT JOIN {name}_c c USING (ordinal) LEFT JOIN pr USING (primer_id))
"""


def exact(name: str, src: str, w: str, role: str, orient: str) -> str:
    """``name``: the primer that a window holds whole."""
    return f"""{name} AS (SELECT ordinal, min_by(primer_id, (-length(pr.seq), instr({w}, pr.seq), primer_id)) AS primer_id
  FROM {src} s JOIN pr ON role = '{role}' AND orient = '{orient}' AND contains({w}, pr.seq) GROUP BY 1)"""


def annotated(src: str = "st") -> str:
    """``an``: merged reads (``ordinal``, ``job_id``, ``name1``, ``seq``, ``qual``) turned, with primers and barcodes."""
    return f"""
a0 AS (SELECT s.*, substr(seq, fmin + 1, foff - fmin) AS fw, CASE WHEN length(seq) >= foff THEN substr(seq, length(seq) - foff + 1, foff - fmin) END AS bw FROM {src} s, pc),
{exact("fe", "a0", "fw", "F", "fwd")}, {exact("be", "a0", "bw", "F", "rc")},
lost AS (SELECT ordinal, fw, bw FROM a0 ANTI JOIN fe USING (ordinal) ANTI JOIN be USING (ordinal)),
lf AS (SELECT ordinal, fw AS w FROM lost), lb AS (SELECT ordinal, bw AS w FROM lost WHERE bw IS NOT NULL),
{approximate("fa", "lf", "F", "fwd")}, {approximate("ba", "lb", "F", "rc")},
a1 AS (
  SELECT a0.*, fe.primer_id AS f1, be.primer_id AS b1, fa.primer_id AS f2, ba.primer_id AS b2,
         fa.primer_id IS NOT NULL AND (coalesce(fa.lcs, 0) >= coalesce(ba.lcs, 0) OR ba.primer_id IS NULL) AS ahead
  FROM a0 LEFT JOIN fe USING (ordinal) LEFT JOIN be USING (ordinal) LEFT JOIN fa USING (ordinal) LEFT JOIN ba USING (ordinal)),
a2 AS (
  SELECT a1.* EXCLUDE (seq, qual), coalesce(f1, x.other, CASE WHEN ahead THEN f2 ELSE y.other END) AS fid,
         CASE WHEN f1 IS NOT NULL THEN false WHEN b1 IS NOT NULL THEN true ELSE NOT ahead END AS turned, seq AS s0, qual AS q0
  FROM a1 LEFT JOIN flip x ON x.primer_id = b1 LEFT JOIN flip y ON y.primer_id = b2),
a3 AS (SELECT ordinal, job_id, name1, fid, CASE WHEN turned THEN {rc("s0")} ELSE s0 END AS seq, CASE WHEN turned THEN reverse(q0) ELSE q0 END AS qual FROM a2 WHERE fid IS NOT NULL),
a4 AS (SELECT a3.*, CASE WHEN length(seq) >= roff THEN substr(seq, length(seq) - roff + 1, roff - rmin) END AS rw FROM a3, pc),
{exact("re", "a4", "rw", "R", "rc")},
lr AS (SELECT ordinal, rw AS w FROM a4 ANTI JOIN re USING (ordinal) WHERE rw IS NOT NULL),
{approximate("ra", "lr", "R", "rc")},
an AS (
  SELECT a4.ordinal, a4.job_id, {display("name1")} AS name, a4.seq, a4.qual, f.name AS vprimer, r.name AS cprimer, left(a4.seq, f.barcode_len) AS fbarcode, right(a4.seq, r.barcode_len) AS rbarcode,
         length(f.seq) AS flen, length(r.seq) AS rlen, f.seq AS fseq, {rc("r.seq")} AS rseq
  FROM a4 LEFT JOIN re USING (ordinal) LEFT JOIN ra USING (ordinal) JOIN flip ON flip.primer_id = coalesce(re.primer_id, ra.primer_id) JOIN pr r ON r.primer_id = flip.other JOIN pr f ON f.primer_id = fid)
"""


#: ``pre``: annotated reads without barcodes and primers.
STRIPPED = """
pre AS (
  SELECT * REPLACE (substr(seq, length(fbarcode) + flen + 1, length(seq) - length(fbarcode) - flen - length(rbarcode) - rlen) AS seq,
                    substr(qual, length(fbarcode) + flen + 1, length(seq) - length(fbarcode) - flen - length(rbarcode) - rlen) AS qual)
  FROM an WHERE length(seq) >= 2 * (length(fbarcode) + flen) + length(rbarcode) + rlen)
"""


def prepared(barcode: bool = False) -> str:
    """All up to ``pt``: prepared reads with their titles, of a mean quality of 25 or more; ``job_id`` is text that is
    never null."""
    tail = " || '|BARCODE=' || fbarcode || '/' || rbarcode" if barcode else ""
    return f"""{PRIMERS}, {merge("(SELECT greatest(foff, roff) FROM pc)")}, {annotated()}, {STRIPPED}, {good("pre")},
pt AS (SELECT * REPLACE (coalesce('=' || job_id, '') AS job_id), name || '|VPRIMER=' || vprimer || '|CPRIMER=' || cprimer{tail} AS title FROM pre_good)"""


def good(src: str, least: int = 25) -> str:
    """``<src>_good``: reads of that mean quality."""
    return f"""
{src}_mq AS (SELECT ordinal, sum(ascii(substr(qual, i, 1)) - 33) // count(*) AS mq FROM {src}, unnest(range(1, length(qual) + 1)) AS u(i) GROUP BY 1),
{src}_good AS (SELECT {src}.* FROM {src} JOIN {src}_mq USING (ordinal) WHERE mq >= {least})"""


def collapsed(src: str, keys: Sequence[str]) -> str:
    """``col``: equal reads as one."""
    k = ", ".join([*keys, "seq"])
    return f"""
heads AS (SELECT {k}, count(*) AS dupcount, min(ordinal) AS first_ordinal, arg_min_null(title, ordinal) AS title FROM {src} GROUP BY ALL),
qs AS (SELECT {k}, i, round_even(avg(ascii(substr(qual, i, 1)) - 33), 0) AS q FROM {src}, unnest(range(1, length(qual) + 1)) AS u(i) GROUP BY ALL),
qj AS (SELECT {k}, string_agg(chr(CAST(q AS INTEGER) + 33), '' ORDER BY i) AS qual FROM qs GROUP BY ALL),
col AS (SELECT * FROM heads JOIN qj USING ({k}))"""


def modal(name: str, src: str, keys: Sequence[str], seq: str = "seq") -> str:
    k = ", ".join(keys)
    return f"""{name} AS (SELECT {k}, len, n FROM (SELECT {k}, length({seq}) AS len, count(*) AS n FROM {src} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY n DESC, len DESC) = 1)"""


def consensus(name: str, src: str, keys: Sequence[str], seq: str = "seq", qual: str = "qual", shortcut: bool = True, extra: Sequence[str] = ()) -> str:
    """``name``: one read for each group."""
    k, n = ", ".join(keys), name
    clear = "coalesce(b2, b1, 'N') AS b, coalesce(p2, p1, 0.0) AS p" if shortcut else "coalesce(b1, 'N') AS b, coalesce(p1, 0.0) AS p"
    more = "".join(f", arg_min_null({c}, ordinal) AS {c}" for c in ("title", *extra))
    return f"""
{modal(f"{n}_modal", src, keys, seq)},
{n}_firsts AS (SELECT {k}, min(ordinal) AS first_ordinal{more} FROM {src} GROUP BY ALL),
{n}_ch AS (SELECT {k}, n, i, substr({seq}, i, 1) AS b, ascii(substr({qual}, i, 1)) - 33 AS q FROM {src} JOIN {n}_modal USING ({k}), unnest(range(1, len + 1)) AS u(i) WHERE length({seq}) = len),
{n}_lg AS (
  SELECT *, CASE WHEN q = 0 THEN 0 ELSE CAST(round(log10(1 - power(10, -q / 10.0)) / 1e-9) AS BIGINT) END AS lq,
         CASE WHEN q = 0 THEN 0 ELSE CAST(round(log10(power(10, -q / 10.0) / 3) / 1e-9) AS BIGINT) END AS le FROM {n}_ch),
{n}_bs(x, o) AS (VALUES ('A', 0), ('T', 1), ('C', 2), ('G', 3)),
{n}_ll AS (SELECT {k}, n, i, x, o, sum(CASE WHEN b = x THEN lq ELSE le END) AS l, count_if(b = x) AS k FROM {n}_lg, {n}_bs GROUP BY ALL),
{n}_mx AS (SELECT *, max(l) OVER (PARTITION BY {k}, i) AS top FROM {n}_ll),
{n}_po AS (SELECT *, power(10, (l - top) * 1e-9) / sum(power(10, (l - top) * 1e-9)) OVER (PARTITION BY {k}, i) AS p FROM {n}_mx),
{n}_pk AS (SELECT {k}, i, any_value(n) AS n, min_by(x, (-p, o)) FILTER (k > 0) AS b1, max(p) FILTER (k > 0) AS p1,
         max(CASE WHEN k > 0.95 * n THEN x END) AS b2, max(CASE WHEN k > 0.95 * n THEN power(10, l / k * 1e-9) END) AS p2 FROM {n}_po GROUP BY ALL),
{n}_cl AS (SELECT {k}, n, i, {clear} FROM {n}_pk),
{n}_cq AS (SELECT *, CAST(floor(-10 * log10(greatest(0.000079, 1 - p)) + 0.5) AS INTEGER) AS q FROM {n}_cl),
{n}_cons AS (SELECT {k}, string_agg(b, '' ORDER BY i) AS seq, string_agg(chr(q + 33), '' ORDER BY i) AS qual, any_value(n) AS conscount FROM {n}_cq GROUP BY ALL),
{n} AS (SELECT * FROM {n}_cons JOIN {n}_firsts USING ({k}))"""


def recollapsed(src: str, keys: Sequence[str], barcodes: bool = False) -> str:
    """``again``: equal consensuses as one."""
    k = ", ".join([*keys, "seq"])
    codes = ", array_to_string(list_sort(list(fbarcode || '_' || rbarcode)), ',') AS barcodes" if barcodes else ""
    return f"""
rh AS (SELECT {k}, count(*) AS dupcount, CAST(sum(conscount) AS BIGINT) AS conscount, arg_min_null(title, first_ordinal) AS title, min(first_ordinal) AS first_ordinal{codes} FROM {src} GROUP BY ALL),
rq AS (SELECT {k}, i, round_even(sum((ascii(substr(qual, i, 1)) - 33) * conscount) / sum(conscount), 0) AS q FROM {src}, unnest(range(1, length(qual) + 1)) AS u(i) GROUP BY ALL),
rj AS (SELECT {k}, string_agg(chr(CAST(q AS INTEGER) + 33), '' ORDER BY i) AS qual FROM rq GROUP BY ALL),
again AS (SELECT * FROM rh JOIN rj USING ({k}))"""


def job(sql: str) -> str:
    """A result whose ``job_id`` is text that is never null, with the job as it was."""
    return f"SELECT * REPLACE (CASE WHEN job_id <> '' THEN substr(job_id, 2) END AS job_id) FROM ({sql})"


def placed(src: str, first: int = 1, window: int = 40) -> str:
    """``placed``: the reference of the reads of ``src`` by the 8-mers from base ``first`` on, and their strand by those
    within ``window`` bases."""
    return f"""
ref AS (SELECT ref_id, rtrim(ref_name) AS ref_name, upper(trim(seq)) AS ref FROM refs),
rs AS (SELECT ref_id, '+' AS strand, ref AS s FROM ref UNION ALL SELECT ref_id, '-', {rc("ref")} FROM ref),
ix AS (SELECT DISTINCT ref_id, strand, substr(s, k, 8) AS kmer FROM rs, unnest(range(1, length(s) - 6)) AS u(k) WHERE regexp_full_match(substr(s, k, 8), '[ACGT]+')),
rk AS (SELECT ordinal, k, substr(seq, k, 8) AS kmer FROM {src}, unnest(range({first}, length(seq) - 6)) AS u(k)),
hit AS (SELECT ordinal, ref_id, strand, count(*) AS hits FROM rk JOIN ix USING (kmer) GROUP BY ALL),
best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY hits DESC, ref_id, strand) = 1),
near AS (
  SELECT ordinal, ref_id, count_if(ix.strand = '+') AS np, count_if(ix.strand = '-') AS nm FROM rk JOIN ix USING (kmer) JOIN (SELECT ordinal, ref_id FROM best) USING (ordinal, ref_id)
  WHERE k <= {first + window - 8} GROUP BY ALL),
placed AS (SELECT best.* REPLACE (CASE WHEN coalesce(np, 0) >= coalesce(nm, 0) THEN '+' ELSE '-' END AS strand) FROM best LEFT JOIN near USING (ordinal, ref_id))"""


#: ``ready``: the clean first reads behind barcode and primer beside the part of their reference that they can reach.
READY = f"""
bs AS (SELECT ordinal, coalesce('=' || job_id, '') AS job_id, {display("name")} AS title, substr(seq, 35) AS seq, substr(qual, 35) AS qual FROM clean WHERE length(seq) > 34),
{placed("bs")},
tu AS (SELECT bs.* REPLACE (CASE strand WHEN '-' THEN {rc("seq")} ELSE seq END AS seq, CASE strand WHEN '-' THEN reverse(qual) ELSE qual END AS qual), ref_id, ref_name, strand, ref FROM bs JOIN placed USING (ordinal) JOIN ref USING (ref_id)),
dg AS (
  SELECT ordinal, v FROM (SELECT ordinal, instr(ref, substr(seq, k, 8)) - k AS v FROM tu, unnest(range(1, length(seq) - 6)) AS u(k) WHERE strand = '-' AND contains(ref, substr(seq, k, 8)))
  GROUP BY ordinal, v QUALIFY row_number() OVER (PARTITION BY ordinal ORDER BY count(*) DESC, v) = 1),
rd AS (
  SELECT tu.* REPLACE (substr(seq, greatest(-coalesce(v, 0), 0) + 1) AS seq, substr(qual, greatest(-coalesce(v, 0), 0) + 1) AS qual,
           substr(ref, greatest(coalesce(v, 0), 0) + 1, length(seq) - greatest(-coalesce(v, 0), 0)) AS ref), greatest(coalesce(v, 0), 0) AS ref_start, length(seq) AS whole
  FROM tu LEFT JOIN dg USING (ordinal)),
ready AS (SELECT * FROM rd WHERE strand = '+' OR whole <= length(ref) * 1.15)
"""

#: ``ready``: prepared reads turned in the direction of the reference that they share most 8-mers with.
GUIDED = f"""
{placed("pre")},
gd AS (SELECT pre.*, ref_id, ref_name, ref, 0 AS ref_start, strand = '+' AS ahead FROM pre JOIN placed USING (ordinal) JOIN ref USING (ref_id)),
ready AS (SELECT * REPLACE (coalesce('=' || job_id, '') AS job_id, CASE WHEN ahead THEN seq ELSE {rc("seq")} END AS seq, CASE WHEN ahead THEN qual ELSE reverse(qual) END AS qual) FROM gd)
"""


def banded(ratio: float = 1.15, gap: int = 9, band: int = 10) -> str:
    """``al``: rows of ``ready`` (``ordinal``, ``seq``, ``qual``, ``ref``) with the operations ``ops`` (M, D, I) of their
    banded alignment up to the end of the reference, of 85 % identity or more.

    A state is a list of the cells of the two latest anti-diagonals, one for each diagonal; cells carry their path."""
    low, span = -100000000, f"range(-{band}, {band + 1})"
    i, j = "(d + 1 + h) // 2", "(d + 1 - h) // 2"
    same = f"substr(x, {i}, 1) = substr(y, {j}, 1)"
    return f"""
cut AS (SELECT *, left(ref, least(length(ref), length(seq))) AS x, left(seq, least(length(ref), length(seq))) AS y FROM ready WHERE length(seq) > 0 AND length(ref) <= length(seq) AND length(seq) <= length(ref) * {ratio}),
todo AS (SELECT DISTINCT x, y, length(x) AS n FROM cut WHERE x <> y),
dp(x, y, n, d, s) USING KEY (x, y) AS (
  SELECT x, y, n, 0, list_transform({span}, lambda h: {{'c': CASE WHEN h = 0 THEN 0 ELSE {low} END, 'k': 2, 'e': false, 'p': ''}}) FROM todo
  UNION
  SELECT x, y, n, d,
    list_transform(t, lambda v, t: CASE
      WHEN v.skip THEN s[t]
      WHEN v.i = 0 THEN {{'c': -d * {gap}, 'k': 2, 'e': false, 'p': s[t + 1].p || 'I'}}
      WHEN v.j = 0 THEN {{'c': -d * {gap}, 'k': 1, 'e': false, 'p': s[t - 1].p || 'D'}}
      WHEN v.a >= v.u AND v.a >= v.l THEN {{'c': v.a, 'k': 0, 'e': v.same, 'p': s[t].p || 'M'}}
      WHEN v.u >= v.l THEN {{'c': v.u, 'k': 1, 'e': v.same, 'p': s[t - 1].p || 'D'}}
      ELSE {{'c': v.l, 'k': 2, 'e': v.same, 'p': s[t + 1].p || 'I'}} END)
  FROM (
    SELECT x, y, n, d + 1 AS d, s, list_transform({span}, lambda h, t: {{
      'i': {i}, 'j': {j}, 'skip': (d + 1 + h) % 2 <> 0 OR d + 1 + h < 0 OR d + 1 - h < 0 OR {i} > n OR {j} > n,
      'same': {same},
      'a': s[t].c + CASE WHEN {same} THEN 5 + 2 * s[t].e::INT ELSE -4 - 2 * s[t].e::INT END,
      'u': CASE WHEN t > 1 THEN s[t - 1].c - {gap} - 2 * (s[t - 1].k = 0)::INT ELSE {low} END,
      'l': CASE WHEN t <= {2 * band} AND {j} > 1 THEN s[t + 1].c - {gap} - 2 * (s[t + 1].k = 0)::INT ELSE {low} END}}) AS t
    FROM dp WHERE d < 2 * n)),
paths AS (SELECT x, y, rtrim(s[{band + 1}].p, 'I') AS ops FROM dp UNION ALL SELECT DISTINCT x, y, repeat('M', length(x)) FROM cut WHERE x = y),
pcell AS (
  SELECT x, y, pos, substr(ops, pos, 1) AS op, length(replace(left(ops, pos), 'I', '')) AS ri, length(replace(left(ops, pos), 'D', '')) AS qi FROM paths, unnest(range(1, length(ops) + 1)) AS u(pos)),
pstr AS (
  SELECT x, y, string_agg(CASE op WHEN 'I' THEN '-' ELSE substr(x, ri, 1) END, '' ORDER BY pos) AS ref_aln, string_agg(CASE op WHEN 'D' THEN '-' ELSE substr(y, qi, 1) END, '' ORDER BY pos) AS read_aln,
         CAST(count_if(op = 'M' AND substr(x, ri, 1) = substr(y, qi, 1)) AS INTEGER) AS matches, CAST(count_if(op = 'D' OR op = 'M' AND substr(x, ri, 1) <> substr(y, qi, 1)) AS INTEGER) AS mismatches_raw,
         CAST(count_if(op = 'M' AND substr(x, ri, 1) <> substr(y, qi, 1)) AS INTEGER) AS mismatches, CAST(count_if(op <> 'M') AS INTEGER) AS gaps, CAST(count_if(op <> 'D') AS BIGINT) AS used, any_value(ops) AS ops
  FROM pcell JOIN paths USING (x, y) GROUP BY ALL),
al AS (SELECT cut.* REPLACE (left(seq, used) AS seq, left(qual, used) AS qual), ref_aln, read_aln, matches, mismatches_raw, mismatches, gaps, ops FROM cut JOIN pstr USING (x, y) WHERE 100.0 * matches / used >= 85)"""


def cells(src: str = "al", start: str = "ref_start") -> str:
    """``cell``: the columns of the alignments ``src``, whose reference begins at ``start``."""
    return f"""
cell AS (
  SELECT ordinal, job_id, ref_id, pos, op, CAST({start} + ri - 1 AS INTEGER) AS ref_pos, CASE op WHEN 'I' THEN '-' ELSE substr(x, ri, 1) END AS r, CASE op WHEN 'D' THEN '-' ELSE substr(y, qi, 1) END AS b,
         ascii(substr(qual, qi, 1)) - 33 AS q
  FROM {src} JOIN pcell USING (x, y))"""


#: The CIGAR of operations.
CIGAR = "array_to_string(list_transform(regexp_extract_all(ops, 'M+|I+|D+'), lambda o: length(o) || left(o, 1)), '')"

#: ``stats``: error statistics of each job, reference and position over ``cell``.
STATS = """
stats AS (
  SELECT job_id, ref_id, ref_pos, count(*) AS n, sum(power(10, -q / 10.0)) AS mu, sqrt(sum(power(10, -q / 10.0) * (1 - power(10, -q / 10.0)))) AS sigma,
         count_if(b = 'A') AS n_a, count_if(b = 'C') AS n_c, count_if(b = 'G') AS n_g, count_if(b = 'T') AS n_t FROM cell WHERE op = 'M' GROUP BY ALL)"""

#: ``fixed``: reads with bases corrected by z-score.
ZSCORE = """
z AS (
  SELECT cell.*, CASE WHEN sigma > 0 THEN (CASE b WHEN 'A' THEN n_a WHEN 'C' THEN n_c WHEN 'G' THEN n_g WHEN 'T' THEN n_t END + 0.5 - mu / 3) / (sigma / sqrt(3)) ELSE 1e9 END AS z
  FROM cell LEFT JOIN stats ON stats.job_id = cell.job_id AND stats.ref_id = cell.ref_id AND stats.ref_pos = cell.ref_pos AND op = 'M'),
fixed AS (
  SELECT ordinal, string_agg(CASE WHEN op = 'M' AND b <> r AND b IN ('A', 'C', 'G', 'T') AND z < 1.645 THEN r WHEN b = '-' THEN '' ELSE b END, '' ORDER BY pos) AS seq FROM z GROUP BY 1)"""


#: ``sides``: consensuses of both reads of each pair of barcodes, as pairs that can be merged.
SIDES = f"""
bp AS (
  SELECT ordinal, coalesce('=' || job_id, '') AS job_id, {display("read_name_first")} AS title, upper(readseq_first) AS s1, quality_first AS q1, upper(readseq_second) AS s2, quality_second AS q2
  FROM read_pair, pc
  WHERE length(readseq_first) = length(quality_first) AND length(readseq_second) = length(quality_second) AND least(length(readseq_first), length(readseq_second)) >= greatest(foff, roff)
    AND regexp_full_match(quality_first, '[!-J]*') AND regexp_full_match(quality_second, '[!-J]*')),
bw AS (SELECT ordinal, substr(s1, fmin + 1, foff - fmin) AS f1, substr(s2, fmin + 1, foff - fmin) AS f2, substr(s1, rmin + 1, roff - rmin) AS r1, substr(s2, rmin + 1, roff - rmin) AS r2 FROM bp, pc),
{exact("fx", "bw", "f1", "F", "fwd")}, {exact("rx", "bw", "r2", "R", "fwd")}, {exact("sf", "bw", "f2", "F", "fwd")}, {exact("sr", "bw", "r1", "R", "fwd")},
no_f AS (SELECT ordinal, f1 AS w FROM bw ANTI JOIN fx USING (ordinal) ANTI JOIN sf USING (ordinal) ANTI JOIN sr USING (ordinal)),
no_r AS (SELECT ordinal, r2 AS w FROM bw ANTI JOIN rx USING (ordinal) ANTI JOIN sf USING (ordinal) ANTI JOIN sr USING (ordinal)),
{approximate("fy", "no_f", "F", "fwd")}, {approximate("ry", "no_r", "R", "fwd")},
bi AS (
  SELECT bp.*, coalesce(fx.primer_id, fy.primer_id) AS f, coalesce(rx.primer_id, ry.primer_id) AS r, sf.primer_id AS g, sr.primer_id AS h
  FROM bp LEFT JOIN fx USING (ordinal) LEFT JOIN fy USING (ordinal) LEFT JOIN rx USING (ordinal) LEFT JOIN ry USING (ordinal) LEFT JOIN sf USING (ordinal) LEFT JOIN sr USING (ordinal)),
bo AS (
  SELECT ordinal, job_id, title, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN f ELSE g END AS fid, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN r ELSE h END AS rid,
         CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN s1 ELSE s2 END AS s1, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN q1 ELSE q2 END AS q1,
         CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN s2 ELSE s1 END AS s2, CASE WHEN f IS NOT NULL AND r IS NOT NULL THEN q2 ELSE q1 END AS q2
  FROM bi WHERE f IS NOT NULL AND r IS NOT NULL OR g IS NOT NULL AND h IS NOT NULL),
bg AS (SELECT bo.*, left(s1, a.barcode_len) AS fbarcode, left(s2, b.barcode_len) AS rbarcode FROM bo JOIN pr a ON a.primer_id = fid JOIN pr b ON b.primer_id = rid),
{consensus("one", "bg", ["job_id", "fbarcode", "rbarcode"], "s1", "q1", shortcut=False)}, {consensus("two", "bg", ["job_id", "fbarcode", "rbarcode"], "s2", "q2", shortcut=False)},
sides AS (
  SELECT one.first_ordinal AS ordinal, job_id, fbarcode, rbarcode, one.title AS read_name_first, one.seq AS readseq_first, one.qual AS quality_first, two.seq AS readseq_second, two.qual AS quality_second,
         two.conscount AS conscount
  FROM one JOIN two USING (job_id, fbarcode, rbarcode))
"""
