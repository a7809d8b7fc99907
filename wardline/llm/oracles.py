"""Oracle SQL, in DuckDB's dialect, of the queries that SQL can express. Ids are taken to be unique and not null."""

from __future__ import annotations

from wardline.llm import secrets

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = rf"regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
      b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
      bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
      dw AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], ' ') AS s FROM (
               SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM bw) ks ON len(w) >= k)),
      h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
      c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
      x AS (SELECT doc_id, count(DISTINCT item_id) AS n, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(c.n, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)"""

NEAR_DUPLICATES = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+k-1], ' ') AS g FROM (
              SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
      l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
      r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
      m AS (SELECT a AS doc_id, least(a, min(b)) AS root FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _places(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """doc_id, kind, rank, first, last, match of the matches of a pattern that are long enough."""
    q = _quoted(pattern)
    return f"""(
      SELECT doc_id, {_quoted(kind)} AS kind, {rank} AS rank, first, first + length(m) AS last, m FROM (
        SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS first FROM (
          SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(string_split_regex(t, {q})[1:len(ms)]) AS gap, unnest(ms) AS m, unnest(gs) AS g
          FROM (SELECT doc_id, t, regexp_extract_all(t, {q}, 0) AS ms, regexp_extract_all(t, {q}, {group}) AS gs FROM t)))
      WHERE length(g) >= {least})"""


_ALPHABET = "string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', '')"
_ALLOWED = " OR ".join(f"regexp_matches(m, {_quoted(a)})" for a in secrets.ALLOWED[:3])
_W, _T = secrets.WINDOW, secrets.THRESHOLDS
_SUM = f"list_sum(list_transform(list_distinct(string_split(win, '')), lambda c: ({_W} - length(replace(win, c, ''))) * log2({_W} - length(replace(win, c, '')))))"

SECRETS = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      base AS ({' UNION ALL '.join(f"SELECT * FROM {_places(k, r, p, *secrets.LEAST[k])}" for r, (k, p) in enumerate(secrets.KINDS.items()))}),
      cand AS (SELECT * FROM {_places("entropy", len(secrets.KINDS), secrets.CANDIDATE, 0, _W)}
               WHERE (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') OR regexp_full_match(m, '[A-Za-z]+')) AND NOT ({_ALLOWED})),
      wins AS (SELECT doc_id, first, m, win FROM (
                 SELECT doc_id, first, m, substr(m, j, {_W}) AS win FROM (SELECT *, unnest(range(1, length(m) - {_W} + 2)) AS j FROM cand))
               WHERE NOT regexp_matches(win, {_quoted(secrets.ALLOWED[4])}) AND len(list_filter({_ALPHABET}, lambda c: contains(win, repeat(c, 6)))) = 0),
      high AS (SELECT doc_id, first, m, max(log2({_W}) - {_SUM} / {_W}) AS h FROM wins GROUP BY ALL),
      added AS (SELECT c.* FROM cand c JOIN high USING (doc_id, first)
                WHERE h >= CASE WHEN regexp_full_match(c.m, '[0-9a-f]+|[0-9A-F]+') THEN {_T['hex']} ELSE {_T['mixed']} END
                  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.first < c.last AND c.first < b.last)),
      allof AS (SELECT *, TRUE AS own FROM base UNION ALL SELECT *, FALSE FROM added),
      listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                   count(*) FILTER (NOT own) AS n_added,
                   string_agg(kind || ':' || CAST(first AS BIGINT) || ':' || CAST(last AS BIGINT), ',' ORDER BY first, rank) FILTER (own) AS mine,
                   string_agg(kind || ':' || CAST(first AS BIGINT) || ':' || CAST(last AS BIGINT), ',' ORDER BY first, rank) AS spans FROM allof GROUP BY doc_id)
    SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(mine, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added
    FROM t LEFT JOIN listed USING (doc_id)"""

#: crc32 by its bits; ids have at most 20 characters.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, c: list_reduce(list_prepend(xor(acc, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda b, z: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)))"""


def _encoded(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _document_leaf(text: str) -> str:
    return f"sha256({' || '.join(_encoded(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree_levels(name: str, start: str, levels: int) -> str:
    """CTEs of the nodes (t, i, d, n) of each level and of their siblings before and after; a finished tree stays as it is."""
    made = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        made.append(f"""{name}s{k} AS MATERIALIZED (SELECT t, i, n,
          coalesce(string_agg(d, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
          coalesce(string_agg(d, '') OVER (PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM {name}{k})""")
        made.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT t, i // 8 AS i, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d,
          (n + 7) // 8 AS n FROM {name}{k} GROUP BY t, i // 8, n)""")
    return ", ".join(made)


def _fold(source: str, name: str, levels: int) -> str:
    """Rows of ``source`` (t, i, f, p) with the digest f folded and the siblings p added up to the end of each tree."""
    for k in range(levels):
        source = f"""(SELECT q.* REPLACE (q.i // 8 AS i, CASE WHEN s.n > 1 THEN sha256(lo || f || hi) ELSE f END AS f, CASE WHEN s.n > 1 THEN p || lo || hi ELSE p END AS p)
          FROM {source} q JOIN {name}s{k} s ON q.t = s.t AND q.i = s.i)"""
    return source


#: Up to 8**7 documents a language and 8**4 languages.
MERKLE = f"""
    WITH docs AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS t, {_document_leaf("text")} AS leaf,
        CASE WHEN {_CRC} % 3 = 0 THEN {_document_leaf(_ASCII_LOWER.format("text"))} END AS claimed FROM documents),
      leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM docs),
      {_tree_levels("x", "SELECT t, i, leaf AS d, n FROM leaves", 7)},
      subs AS MATERIALIZED (SELECT t AS g, d AS subroot, row_number() OVER (ORDER BY encode(t)) - 1 AS j, count(*) OVER () AS n FROM x7),
      {_tree_levels("y", "SELECT 0 AS t, j AS i, subroot AS d, n FROM subs", 4)},
      lower AS (SELECT * FROM {_fold("(SELECT doc_id, t, i, leaf, coalesce(claimed, leaf) AS f, '' AS p FROM leaves)", "x", 7)}),
      whole AS (SELECT * FROM {_fold("(SELECT doc_id, leaf, subroot, 0 AS t, j AS i, f, p FROM lower JOIN subs ON g = t)", "y", 4)})
    SELECT doc_id, leaf, subroot, d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = d AS verified FROM whole JOIN y4 ON TRUE"""

INFILL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
      c AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
              CAST('0x' || h[25:32] AS BIGINT) % 100 AS c4 FROM d),
      f AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2)+1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2)+1:], '') AS s,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN c4 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM f"""

ORACLES = {
    "op4_decontamination": DECONTAMINATION, "op6_minhash_dedup": NEAR_DUPLICATES, "op8_secret_scan": SECRETS,
    "op12_merkle_manifest": MERKLE, "op13_fill_in_middle": INFILL,
}
