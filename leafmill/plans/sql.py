"""Fragments shared by the SQL that checks the registered queries."""

from __future__ import annotations

from leafmill.functions.text import WHITESPACE, WS

SIZE = 200


def strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def tokens(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '\p{{Han}}|[^{WHITESPACE}\p{{Han}}\p{{P}}\p{{S}}]+')"


def pieces(text: str, pattern: str) -> str:
    parts = f"list_transform(string_split_regex({text}, '{pattern}'), lambda x: {strip('x')})"
    return f"list_filter({parts}, lambda x: x <> '')"


def rewrite(text: str, rules) -> str:
    for pattern, replacement in rules:
        new = replacement.replace(r"\n", "\n").replace("'", "''")
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{new}', 'g')"
    return text


def sentence_chunks(table: str, key: str, text: str, name: str = "sentence_chunks") -> str:
    """CTEs that end in ``name(key, chunk_index, text)``: sentences packed by length."""
    return f"""
    {name}_l AS (SELECT {key}, {pieces(text, '[。！？.!?]')} AS ps FROM {table}),
    {name}_s AS (SELECT {key}, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM {name}_l),
    {name}_f AS (
      SELECT {key}, pos, p, length(p) + 1 AS used, CAST(1 AS BIGINT) AS g FROM {name}_s WHERE pos = 1
      UNION ALL
      SELECT s.{key}, s.pos, s.p,
             CASE WHEN f.used + length(s.p) > {SIZE} THEN length(s.p) + 1 ELSE f.used + length(s.p) + 1 END,
             CASE WHEN f.used + length(s.p) > {SIZE} THEN f.g + 1 ELSE f.g END
      FROM {name}_f f JOIN {name}_s s ON s.{key} = f.{key} AND s.pos = f.pos + 1),
    {name} AS (
      SELECT {key}, g - 1 AS chunk_index, string_agg(p, '。' ORDER BY pos) || '。' AS text
      FROM {name}_f GROUP BY {key}, g)
    """


def sections(table: str) -> str:
    """CTEs that end in ``sections(id, chunk_index, path, text)``: text between headings."""
    return f"""
    ln AS (SELECT id, {strip('unnest(ls)')} AS line, generate_subscripts(ls, 1) AS pos
           FROM (SELECT id, string_split(text, chr(10)) AS ls FROM {table})),
    hd AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}( .*)?$') THEN length(regexp_extract(line, '^#+')) ELSE 0 END AS lev
           FROM ln),
    sec AS (SELECT *, sum(CASE WHEN lev > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS sec FROM hd),
    body AS (
      SELECT id, sec, {strip("string_agg(line, chr(10) ORDER BY pos)")} AS text
      FROM sec WHERE lev = 0 GROUP BY id, sec),
    heads AS (SELECT id, sec, lev, {strip("regexp_replace(line, '^#+', '')")} AS name FROM sec WHERE lev > 0),
    above AS (
      SELECT b.id, b.sec, h.sec AS hsec, h.lev, h.name,
             min(h.lev) OVER (PARTITION BY b.id, b.sec ORDER BY h.sec DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later
      FROM body b JOIN heads h ON h.id = b.id AND h.sec <= b.sec),
    paths AS (
      SELECT id, sec, string_agg(name, ' > ' ORDER BY hsec) AS path
      FROM above WHERE later IS NULL OR lev < later GROUP BY id, sec),
    sections AS (
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY sec) - 1 AS chunk_index,
             coalesce(path, '') AS path, regexp_replace(text, '\\n{{2,}}', '  ' || chr(10), 'g') AS text
      FROM body LEFT JOIN paths USING (id, sec) WHERE text <> '')
    """


def sentence_tokens(table: str, key: str, text: str) -> str:
    """CTEs that end in ``sentence_tokens(key, chunk_index, text)``: sentences packed by
    token count, trailing ones repeated."""
    marks = "。！？.!?"
    word = rf"\p{{Han}}|[^{WHITESPACE}\p{{Han}}]+"
    stretch = rf"(?:(?:{word})[{WHITESPACE}]*){{1,{SIZE}}}"
    found = f"regexp_extract_all({text}, '[^{marks}]*[{marks}]+|[^{marks}]+')"
    return f"""
    st_s AS (SELECT {key}, list_filter(list_transform({found}, lambda x: {strip('x')}), lambda x: x <> '') AS ss FROM {table}),
    st_l AS (
      SELECT {key}, list_transform(flatten(list_transform(ss, lambda x:
               CASE WHEN len(regexp_extract_all(x, '{word}')) > {SIZE} THEN regexp_extract_all(x, '{stretch}') ELSE [x] END)),
               lambda x: {strip('x')}) AS ps FROM st_s),
    st_u AS (SELECT {key}, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM st_l),
    st_n AS (SELECT *, len(regexp_extract_all(p, '{word}')) AS n FROM st_u),
    st AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {key} ORDER BY pos) AS BIGINT) AS cum FROM st_n),
    st_e AS (
      SELECT a.{key}, a.pos AS f, max(b.pos) AS e FROM st a
      JOIN st b ON b.{key} = a.{key} AND b.pos >= a.pos AND b.cum - (a.cum - a.n) <= {SIZE} GROUP BY ALL),
    st_x AS (
      SELECT w.{key}, w.f, min(p.pos) AS nf FROM st_e w
      JOIN st l ON l.{key} = w.{key} AND l.pos = w.e
      JOIN st t ON t.{key} = w.{key} AND t.pos = w.e + 1
      JOIN st p ON p.{key} = w.{key} AND p.pos > w.f AND p.pos <= w.e + 1
               AND l.cum - (p.cum - p.n) <= least(20, {SIZE} - t.n)
      GROUP BY ALL),
    st_w AS (
      SELECT {key}, CAST(0 AS BIGINT) AS chunk_index, CAST(1 AS BIGINT) AS f FROM st WHERE pos = 1
      UNION ALL SELECT w.{key}, w.chunk_index + 1, x.nf FROM st_w w JOIN st_x x ON x.{key} = w.{key} AND x.f = w.f),
    sentence_tokens AS (
      SELECT w.{key}, w.chunk_index, string_agg(p, ' ' ORDER BY pos) AS text
      FROM st_w w JOIN st_e e ON e.{key} = w.{key} AND e.f = w.f
      JOIN st s ON s.{key} = w.{key} AND s.pos BETWEEN w.f AND e.e GROUP BY ALL)
    """


def recursive_chunks(table: str, key: str, text: str, separators: tuple[str, ...], overlap: int = 20) -> str:
    """CTEs that end in ``recursive(key, chunk_index, text)``: a level per separator, parts packed
    by length, trailing ones repeated; the empty separator, the last one, cuts by characters."""
    levels = [f"rc_0 AS (SELECT {key}, [0::BIGINT] AS path, {text} AS t, true AS open FROM {table} WHERE {text} IS NOT NULL)"]
    for i, mark in enumerate(separators):
        own = mark.replace("'", "''").replace("\n", "' || chr(10) || '")
        here = f"open AND contains(t, '{own}')" if mark else "open"
        kept = f"SELECT * FROM rc_{i} WHERE NOT ({here})"
        if not mark:
            step = SIZE - overlap
            levels.append(f"""
    rc_{i + 1} AS (
      {kept} UNION ALL
      SELECT {key}, list_append(path, k), {strip(f'substr(t, k * {step} + 1, {SIZE})')}, false
      FROM rc_{i}, unnest(range(0, greatest(0, ceil((length(t) - {SIZE}) / {step}::DOUBLE))::BIGINT + 1)) AS r(k) WHERE {here})""")
            continue
        levels.append(f"""
    r{i}_l AS (
      SELECT {key}, path, list_filter(list_transform(string_split(t, '{own}'), lambda x, j: CASE WHEN j = 1 THEN x ELSE '{own}' || x END), lambda x: x <> '') AS ps
      FROM rc_{i} WHERE {here}),
    r{i}_u AS (SELECT {key}, path, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM r{i}_l),
    r{i}_g AS (SELECT *, length(p) AS n, count_if(length(p) >= {SIZE}) OVER (PARTITION BY {key}, path ORDER BY pos) AS g FROM r{i}_u),
    r{i}_s AS (
      SELECT *, CAST(sum(n) OVER (PARTITION BY {key}, path, g ORDER BY pos) AS BIGINT) AS cum FROM r{i}_g WHERE n < {SIZE}),
    r{i}_e AS (
      SELECT a.{key}, a.path, a.g, a.pos AS f, max(b.pos) AS e FROM r{i}_s a
      JOIN r{i}_s b ON b.{key} = a.{key} AND b.path = a.path AND b.g = a.g AND b.pos >= a.pos AND b.cum - (a.cum - a.n) <= {SIZE} GROUP BY ALL),
    r{i}_x AS (
      SELECT w.{key}, w.path, w.g, w.f, min(p.pos) AS nf FROM r{i}_e w
      JOIN r{i}_s l ON l.{key} = w.{key} AND l.path = w.path AND l.pos = w.e
      JOIN r{i}_s x ON x.{key} = w.{key} AND x.path = w.path AND x.g = w.g AND x.pos = w.e + 1
      JOIN r{i}_s p ON p.{key} = w.{key} AND p.path = w.path AND p.g = w.g AND p.pos > w.f AND p.pos <= w.e + 1
           AND l.cum - (p.cum - p.n) <= least({overlap}, {SIZE} - x.n)
      GROUP BY ALL),
    r{i}_w AS (
      SELECT {key}, path, g, min(pos) AS f FROM r{i}_s GROUP BY ALL
      UNION ALL SELECT w.{key}, w.path, w.g, x.nf FROM r{i}_w w JOIN r{i}_x x ON x.{key} = w.{key} AND x.path = w.path AND x.g = w.g AND x.f = w.f),
    r{i}_c AS (
      SELECT w.{key}, w.path, w.f, string_agg(s.p, '' ORDER BY s.pos) AS t
      FROM r{i}_w w JOIN r{i}_e e ON e.{key} = w.{key} AND e.path = w.path AND e.g = w.g AND e.f = w.f
      JOIN r{i}_s s ON s.{key} = w.{key} AND s.path = w.path AND s.pos BETWEEN w.f AND e.e GROUP BY ALL),
    rc_{i + 1} AS (
      {kept} UNION ALL
      SELECT {key}, list_append(path, f), {strip('t')}, false FROM r{i}_c UNION ALL
      SELECT {key}, list_append(path, pos), p, true FROM r{i}_g WHERE n >= {SIZE})""")
    levels.append(f"""
    recursive AS (
      SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY path) - 1 AS chunk_index, t AS text FROM rc_{len(separators)} WHERE t <> '')""")
    return ",".join(levels)


# CTEs that end in chunks(doc_id, chunk_index, text): the basic chunker over
# documents, with single line breaks between paragraphs.
CHUNKS = f"""
    para_l AS (SELECT doc_id, {pieces('text', chr(10))} AS ps FROM documents),
    para AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM para_l),
    para_f AS (
      SELECT doc_id, pos, p, CASE WHEN length(p) > {SIZE} THEN 0 ELSE length(p) + 2 END AS used, 1 AS g
      FROM para WHERE pos = 1
      UNION ALL
      SELECT n.doc_id, n.pos, n.p,
             CASE WHEN length(n.p) > {SIZE} THEN 0
                  WHEN f.used = 0 OR f.used + length(n.p) > {SIZE} THEN length(n.p) + 2
                  ELSE f.used + length(n.p) + 2 END,
             CASE WHEN length(n.p) > {SIZE} OR f.used = 0 OR f.used + length(n.p) > {SIZE}
                  THEN f.g + 1 ELSE f.g END
      FROM para_f f JOIN para n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1),
    long_p AS (SELECT doc_id || ':' || g AS run, doc_id, g, p FROM para_f WHERE length(p) > {SIZE}),
    {sentence_chunks('long_p', 'run', 'p', 'long_c')},
    every AS (
      SELECT doc_id, g, 0 AS sub, string_agg(p, chr(10) || chr(10) ORDER BY pos) AS text
      FROM para_f WHERE length(p) <= {SIZE} GROUP BY doc_id, g
      UNION ALL
      SELECT l.doc_id, l.g, c.chunk_index, c.text FROM long_c c JOIN long_p l USING (run)),
    chunks AS (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g, sub) - 1 AS chunk_index, text
      FROM every)
"""


def hashed(table: str, key: str, text: str, name: str, dim: int = 64) -> str:
    """CTEs that end in ``name(key, dim, x)``: the hashed unit bag of words."""
    return f"""
    {name}_b AS (
      SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {dim} AS dim, count(*) AS n
      FROM (SELECT {key}, unnest({tokens(text)}) AS w FROM {table}) GROUP BY ALL),
    {name}_z AS (SELECT {key}, sqrt(sum(n * n)) AS z FROM {name}_b GROUP BY {key}),
    {name} AS (
      SELECT {key}, dim, CAST(CAST(n / z AS FLOAT) AS DOUBLE) AS x FROM {name}_b JOIN {name}_z USING ({key}))
    """


def ranked(source: str, k: int = 5) -> str:
    return f"""
      SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM {source} QUALIFY rank <= {k}
    """


# CTEs that end in text_hits(query_id, id, score, rank): benchmark texts against documents.
TEXT_HITS = f"""
    {hashed('documents', 'doc_id', 'text', 'dv')},
    {hashed('benchmark', 'item_id', 'text', 'qv')},
    dn AS (SELECT doc_id, sqrt(sum(x * x)) AS z FROM dv GROUP BY doc_id),
    qn AS (SELECT item_id, sqrt(sum(x * x)) AS z FROM qv GROUP BY item_id),
    dot AS (SELECT item_id, doc_id, sum(dv.x * qv.x) AS s FROM dv JOIN qv USING (dim) GROUP BY ALL),
    text_all AS (
      SELECT item_id AS query_id, dn.doc_id AS id, round(coalesce(s, 0) / (dn.z * qn.z), 6) AS score
      FROM qn CROSS JOIN dn LEFT JOIN dot USING (item_id, doc_id)),
    text_hits AS ({ranked('text_all')})
"""

# CTEs that end in bm25_hits(query_id, id, score, rank).
BM25_HITS = f"""
    dt AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
    len AS (SELECT doc_id, len({tokens('text')}) AS n FROM documents),
    tot AS (SELECT count(*) AS n, avg(n) AS mean FROM len),
    qt AS (SELECT DISTINCT item_id, unnest({tokens('text')}) AS term FROM benchmark),
    df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM qt) GROUP BY term),
    bm25_all AS (
      SELECT item_id AS query_id, doc_id AS id, round(sum(
               ln(1 + (tot.n - df + 0.5) / (df + 0.5))
               * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len.n / tot.mean))), 6) AS score
      FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN tot
      GROUP BY ALL),
    bm25_hits AS ({ranked('bm25_all')})
"""

# CTEs that end in knn_hits(query_id, id, score, rank): every vector against all others.
KNN_HITS = f"""
    knn_all AS (
      SELECT q.vec_id AS query_id, c.vec_id AS id,
             round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
    knn_hits AS ({ranked('knn_all')})
"""

__all__ = ["BM25_HITS", "CHUNKS", "KNN_HITS", "TEXT_HITS", "WS", "hashed", "pieces", "ranked", "recursive_chunks", "rewrite", "sections", "sentence_tokens", "strip", "tokens"]
