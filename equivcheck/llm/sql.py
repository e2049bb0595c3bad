"""DuckDB SQL with the rows of the queries, where SQL can say them.

The others are held against plain Python in the tests: XXH64 fingerprints and components, random
vectors, trained models, Feistel rounds, merges of byte pairs, and mixtures and replies, whose steps are
not single queries.
"""

from __future__ import annotations

from equivcheck.llm.quality import BOILERPLATE, SEPARATORS, SYMBOLS
from equivcheck.llm.queries import SITES
from equivcheck.llm.variants import RUN

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = r"[\x20\x09-\x0D]+"


def _listed(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACES}'), lambda w: w <> '')"


def _covered(found: str) -> str:
    """Words in the union of spans (rid, first word, number of words)."""
    return f"SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(n)) AS k FROM {found}) GROUP BY rid"


def _quality() -> str:
    chars = f"length(regexp_replace(x, '{_SPACES}', '', 'g'))"
    symbols = f"length(x) - length(translate(x, '{SYMBOLS}', ''))"
    phrases = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    separators = f"len(list_filter({_words('x')}, lambda y: y IN ({_listed(SEPARATORS)})))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {_words('t')} AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
    g AS (SELECT rid, i, 8 AS n, array_to_string(ws[i : i + 7], ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
    twice AS (SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
    repeated AS ({_covered('twice')}),
    lines AS (SELECT rid, unnest(ls) AS x FROM w),
    lost AS (SELECT rid, sum({chars}) AS n FROM lines
        WHERE NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]') OR ({symbols}) * 100 > {chars} * 15
        OR ({separators} >= 3 AND {separators} * 5 >= len({_words('x')})) OR {phrases} GROUP BY rid),
    c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACES}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
        coalesce(lost.n, 0)::BIGINT AS lost_chars
        FROM w LEFT JOIN repeated USING (rid) LEFT JOIN lost USING (rid))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars * 100 <= word_chars * 50 AS kept FROM c
    """


def _contamination() -> str:
    words = (
        f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS ws FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS ws FROM benchmark),
    pat AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (
        SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i
        FROM b WHERE len(ws) > 0)),
    seen AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS g FROM (
        SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM pat) WHERE len(ws) >= n)),
    occ AS (SELECT rid, i, n, item FROM seen JOIN pat USING (n, g)),
    hits AS ({_covered('occ')}),
    items AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM occ GROUP BY rid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit,
        coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
        coalesce(hits.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
    """


def _urls() -> str:
    sites = ", ".join(
        f"('{name}', '{verdict}', '{name.partition('/')[0]}', '/{name.partition('/')[2]}')" for name, verdict in SITES
    )
    # The globs of queries.BLOCKED.
    blocked = (
        "contains(host, 'ads-track') OR contains(host, 'spam-') OR contains(host, 'adult-') "
        "OR contains(host, 'casino') OR contains(path, '/ads/') OR ends_with(path, '.exe')"
    )
    return f"""
    WITH p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
        THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM p),
    x AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM h),
    r(name, verdict, h, p) AS (VALUES {sites}),
    f AS (SELECT x.*, (SELECT max_by(name, length(name)) FROM r
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule FROM x)
    SELECT page_id, host, path, rule, coalesce((SELECT verdict FROM r WHERE name = rule),
        CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict FROM f
    """


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's bytes, by half bytes, the lower half first."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    halves = f"list_transform(range(2 * strlen({text})), lambda i: strpos('0123456789ABCDEF', hex(encode({text}))[xor(i, 1) + 1]) - 1)"
    step = f"xor(c >> 4, ({table}::BIGINT[])[(xor(c, x) & 15) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || {halves}::BIGINT[], lambda c, x: {step}), 4294967295)"


def _manifest() -> str:
    def leaf(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        parts = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields]
        return f"sha256({' || '.join(parts)})"

    def levels(name: str, start: str) -> str:
        return f"""{name}(grp, lvl, pos, d, n) AS ({start} UNION ALL
        SELECT grp, lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), any_value((n + 15) // 16)
        FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 16)"""

    def steps(key: str, rows: str, tree: str, offset: int) -> str:
        # Siblings of a row in each level of a tree, on its left and on its right.
        return f"""SELECT {key}, {offset} + lvl AS lvl,
        coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos < x.pos // (1 << (4 * lvl))), '') AS l,
        coalesce(string_agg(t.d, '' ORDER BY t.pos) FILTER (t.pos > x.pos // (1 << (4 * lvl))), '') AS r
        FROM {rows} x JOIN {tree} t ON t.grp = x.grp AND t.n > 1 AND t.pos // 16 = x.pos // (1 << (4 * lvl + 4))
        GROUP BY {key}, lvl"""

    changed = f"doc_id IS NOT NULL AND {_crc32('doc_id::VARCHAR')} % 5 = 0"
    other = f"CASE WHEN {changed} THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    return f"""
    WITH RECURSIVE d AS (SELECT *, {leaf('text')} AS leaf, {other} AS told FROM documents),
    c AS (SELECT row_number() OVER () AS rid, doc_id, leaf, {leaf('told')} AS claimed, coalesce('=' || source, '') AS grp,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n FROM d),
    {levels('tree', 'SELECT grp, 0, pos, leaf, n FROM c')},
    s AS (SELECT grp AS own, '' AS grp, d AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos,
        count(*) OVER () AS n FROM tree WHERE n = 1),
    {levels('top', "SELECT grp, 0, pos, subroot, n FROM s")},
    low AS ({steps('rid', 'c', 'tree', 0)}),
    high AS ({steps('own', 's', 'top', 100)}),
    path AS (SELECT rid, lvl, l, r FROM low UNION ALL SELECT rid, lvl, l, r FROM c JOIN high ON c.grp = high.own),
    k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY lvl) AS k FROM path),
    fold(rid, k, d) AS (SELECT rid, 0::BIGINT, claimed FROM c UNION ALL
        SELECT fold.rid, k.k, sha256(l || d || r) FROM fold JOIN k ON k.rid = fold.rid AND k.k = fold.k + 1),
    ends AS (SELECT rid, max_by(d, k) AS folded_root FROM fold GROUP BY rid),
    proofs AS (SELECT rid, string_agg(l || r, '' ORDER BY k) AS p FROM k GROUP BY rid),
    root AS (SELECT d AS root FROM top WHERE n = 1)
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM c JOIN s ON c.grp = s.own JOIN ends USING (rid) LEFT JOIN proofs USING (rid), root
    """


def _variants() -> str:
    return f"""
    WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, '') AS id,
        unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{RUN}')) AS run
        FROM documents),
    r AS (SELECT id, run, count(*) AS n, id || ':' || run AS named FROM t GROUP BY id, run),
    h AS (SELECT run, n, {_crc32('named')} AS h FROM r),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
        ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
    g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS gap FROM w),
    v AS (SELECT word, n, gap, substr(word, 1, gap - 1) || substr(word, gap + 1) AS part FROM g),
    one AS (SELECT DISTINCT v.word AS a, w.word AS b, w.n AS bn, v.n AS an FROM v JOIN w ON v.part = w.word),
    near AS (SELECT a, b, bn FROM one UNION ALL SELECT b, a, an FROM one UNION ALL
        SELECT DISTINCT x.word, y.word, y.n FROM v x JOIN v y ON x.part = y.part AND x.gap = y.gap AND x.word <> y.word),
    best AS (SELECT a, count(*) AS n_near, arg_min(b, (-bn, b)) AS b, max(bn) AS bn FROM near GROUP BY a),
    f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN bn >= 5 * n THEN b END AS form,
        CASE WHEN bn >= 5 * n THEN bn END AS form_n FROM w LEFT JOIN best ON word = a),
    up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE form IS NOT NULL)
    SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word
        JOIN f AS e ON e.word = up.root AND e.form IS NULL
    """


SQL: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op4_decontamination": _contamination(),
    "op10_url_filter": _urls(),
    "op11_merkle_manifest": _manifest(),
    "op13_spelling_variants": _variants(),
}
