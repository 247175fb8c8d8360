"""The quality rules as SQL for DuckDB, written from the same fixed values."""

from __future__ import annotations

import math

from .quality_rules import RARE_CLASSES, Rules

_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _divergence(counts: str, total: str, reference: str) -> str:
    p, q = f"(CASE WHEN {total} > 0 THEN {counts}[i] / {total} ELSE 0 END)", f"{reference}[i]"
    one = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0 END)"
    return f"greatest(0, list_sum(list_transform(range(1, len({counts}) + 1), lambda i: ({one(p)} + {one(q)}) / 2)))"


def quality_sql(rules: Rules = Rules(), table: str = "documents") -> str:
    rare = ", ".join(f"length(regexp_replace(rare, {_text(f'[^{members}]+')}, '', 'g')) AS {name}" for name, members in RARE_CLASSES.items())
    known = " + ".join(RARE_CLASSES)
    own = {lang: ", ".join(f"len(list_filter(ws, lambda x: x IN ({_text(w)}, {_text(w.capitalize())})))" for w in words) for lang, words in rules.common_words.items()}
    lists = ", ".join(f"[{counts}] AS own_{lang}" for lang, counts in own.items())
    full = ", ".join(f"list_transform(list_append(own_{lang}, n_words - list_sum(own_{lang})), lambda x: CAST(x AS DOUBLE)) AS w_{lang}" for lang in own)
    judged = f"n_words >= {rules.judged_words} AND n_chars >= {rules.judged_chars}"
    mean = lambda xs, total, n: "[" + ", ".join(f"avg(CASE WHEN {total} > 0 THEN {xs}[{i}] / {total} ELSE 0 END)" for i in range(1, n + 1)) + "]"
    n_classes = len(RARE_CLASSES) + 2
    means = ", ".join(f"ref_{lang} AS (SELECT {mean('classes', 'word_chars', n_classes)} AS rc, {mean(f'w_{lang}', 'n_words', len(words) + 1)} AS rw, count(*) AS n FROM shares WHERE lang = {_text(lang)} AND {judged})" for lang, words in rules.common_words.items())
    excess = []
    for lang, words in rules.common_words.items():
        chance = f"{len(words) / (8 * math.log(2))!r} / greatest(n_words, 1)"
        by_class, by_word = _divergence("classes", "word_chars", f"ref_{lang}.rc"), _divergence(f"w_{lang}", "n_words", f"ref_{lang}.rw")
        excess.append(f"CASE WHEN ref_{lang}.n > 0 THEN {by_class} / {rules.class_limit} + greatest(0, {by_word} - {chance}) / {rules.word_limit} END")
    failed = f"n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words"
    return rf"""
WITH texts AS (SELECT doc_id, lang, COALESCE(text, '') AS t FROM {table}),
split AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws, regexp_replace(t, '[a-z\x20\x09-\x0D]+', '', 'g') AS rare,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM texts),
counts AS (SELECT *, length(t) AS n_chars, len(ws) AS n_words, length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS word_chars, {rare}, {lists} FROM split),
spans AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, run FROM spans GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM spans JOIN twice USING (doc_id, run)), range(3) AS r(j) GROUP BY doc_id),
shares AS (SELECT c.doc_id, lang, n_chars, n_words, word_chars, symbol, len(lines) - len(list_distinct(lines)) AS dup, COALESCE(covered.n, 0) AS n_repeat_words,
  [word_chars - length(rare), {", ".join(RARE_CLASSES)}, length(rare) - ({known})]::DOUBLE[] AS classes, {full} FROM counts c LEFT JOIN covered ON c.doc_id = covered.doc_id),
{means},
verdicts AS (SELECT *, least({", ".join(excess)}) AS excess FROM shares, {", ".join(f"ref_{lang}" for lang in own)})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  ({failed}) AS base_failed, NOT ({failed}) AND (NOT ({judged}) OR COALESCE(excess, 0) <= 1.0) AS kept FROM verdicts"""
