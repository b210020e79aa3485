"""DuckDB SQL for the queries of this subpackage that SQL can express, written from what they must return."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, bit by bit (lowest first) with the reversed polynomial 0xEDB88320."""
    byte = f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(encode({text})), 2 * k + 2, 1)) - 1"
    bits = f"flatten(list_transform(range(strlen({text})), lambda k: list_transform(range(8), lambda b: (({byte}) >> b) & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"


def _part(x: str) -> str:
    return f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"


def _leaf(chars: str) -> str:
    return f"sha256({' || '.join(map(_part, ('doc_id', 'source', 'lang', chars, 'text')))})"


MERKLE = f"""WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_leaf("n_chars")} leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END used FROM documents),
 placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 pos FROM leaves),
 low AS (SELECT lang, 0 lvl, pos i, leaf h, count(*) OVER (PARTITION BY lang) n FROM placed
  UNION ALL SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, lvl, i // 2),
 subs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 place FROM low WHERE n = 1),
 high AS (SELECT 0 lvl, place i, h, count(*) OVER () n FROM subs
  UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, i // 2),
 top AS (SELECT h root FROM high WHERE n = 1),
 beside AS (SELECT p.lang, p.pos, low.lvl, CASE WHEN low.i % 2 = 0 THEN 'L' ELSE 'R' END || low.h s FROM placed p JOIN low ON p.lang IS NOT DISTINCT FROM low.lang AND low.n > 1 AND low.i = xor(p.pos >> low.lvl, 1)
  UNION ALL SELECT lang, pos, low.lvl, '' FROM placed p JOIN (SELECT lang l, lvl, max(n) n FROM low WHERE n > 1 GROUP BY ALL) low ON p.lang IS NOT DISTINCT FROM low.l AND xor(p.pos >> low.lvl, 1) >= low.n
  UNION ALL SELECT p.lang, p.pos, 1000 + high.lvl, CASE WHEN high.i % 2 = 0 THEN 'L' ELSE 'R' END || high.h FROM placed p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang JOIN high ON high.n > 1 AND high.i = xor(place >> high.lvl, 1)
  UNION ALL SELECT p.lang, p.pos, 1000 + h.lvl, '' FROM placed p JOIN subs ON p.lang IS NOT DISTINCT FROM subs.lang JOIN (SELECT lvl, max(n) n FROM high WHERE n > 1 GROUP BY ALL) h ON xor(place >> h.lvl, 1) >= h.n),
 paths AS (SELECT lang, pos, list(s ORDER BY lvl) path FROM beside GROUP BY lang, pos),
 folded AS (SELECT doc_id, leaf, subs.h subroot, root, sha256(list_reduce(list_concat([''], list_transform(coalesce(path, []), lambda s: substr(s, 2))), lambda a, s: a || s)) proof_sha256,
  list_reduce(list_concat([coalesce(used, leaf)], coalesce(path, [])), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN substr(s, 2) || a WHEN s[1] = 'R' THEN a || substr(s, 2) ELSE a END)) folded_root
  FROM placed LEFT JOIN paths ON placed.lang IS NOT DISTINCT FROM paths.lang AND placed.pos = paths.pos JOIN subs ON placed.lang IS NOT DISTINCT FROM subs.lang CROSS JOIN top)
 SELECT *, folded_root = root verified FROM folded"""

_RUN = "doc_id::VARCHAR || ':' || run"
VARIANTS = f"""WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') doc_id, translate(unnest(regexp_extract_all("text", '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run FROM documents),
 counted AS (SELECT doc_id, run, count(*) n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
 hashed AS (SELECT run, n, {_crc32(_RUN)} h FROM counted),
 words AS (SELECT word, sum(n)::BIGINT n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, n FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 cut AS (SELECT word, n, k, substr(word, 1, k) || '|' || substr(word, k + 2) mask FROM words, LATERAL (SELECT unnest(range(length(word))) k)),
 links AS (SELECT DISTINCT a.word, b.word near, b.n near_n FROM cut a JOIN cut b ON a.mask = b.mask AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON replace(a.mask, '|', '') = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON replace(a.mask, '|', '') = b.word),
 best AS (SELECT word, count(*) n_near, max(near_n) form_n, arg_min(near, (-near_n, near)) form FROM links GROUP BY word),
 forms AS (SELECT words.word, n, coalesce(n_near, 0) n_near, CASE WHEN form_n >= 10 * n THEN form END form, CASE WHEN form_n >= 10 * n THEN form_n END form_n FROM words LEFT JOIN best USING (word)),
 steps AS (SELECT word, word AS tip FROM forms UNION ALL SELECT steps.word, form FROM steps JOIN forms ON steps.tip = forms.word WHERE form IS NOT NULL),
 roots AS (SELECT steps.word, tip AS root FROM steps JOIN forms ON steps.tip = forms.word WHERE form IS NULL)
 SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)"""
