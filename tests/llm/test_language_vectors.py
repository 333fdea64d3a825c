"""Language predictions against vectors that are built, bundled and compared one by one."""

from __future__ import annotations

import zlib

import numpy as np

from ledgerline.llm import language_id


def plain_trigrams(text):
    """Symbols with a gap around and between words; trigrams with a letter in the middle."""
    table = language_id.symbol_table()
    sym = [0]
    for ch in text:
        s = int(table[ord(ch)])
        if s or sym[-1]:
            sym.append(s)
    if sym[-1]:
        sym.append(0)
    return [t for t in zip(sym, sym[1:], sym[2:], strict=False) if t[1]]


def text_vector(text, letters):
    out = np.zeros(letters.shape[1])
    for a, b, c in plain_trigrams(text):
        out += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return out


def test_predictions_are_the_largest_cosines(spark):
    rng = np.random.default_rng(11)
    parts = {"aa": ["tion", "the", "ing", "er", "and"], "bb": ["schen", "ung", "ein", "lich", "der"], "cc": ["ción", "que", "los", "ado", "né"], "dd": ["eau", "ais", "les", "ç", "oux"]}
    rows = []
    for i in range(200):
        lang = list(parts)[i % 4]
        own = parts[lang] + list(rng.choice(sum(parts.values(), []), 3))  # languages share letters and some syllables
        rows.append((i, " ".join("".join(rng.choice(own, 2)) for _ in range(int(rng.integers(1, 12)))) + str(rng.choice([".", "!", " 12", ""])), lang if i % 9 else None))
    rows += [(900, "", "aa"), (901, None, "bb"), (902, "12 !", "cc"), (903, "ЖЖЖ щщщ", None)]
    letters = language_id.letter_vectors().astype(np.float64)
    vectors = {i: text_vector(t or "", letters) for i, t, _ in rows}
    prototypes = {}
    for i, _, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            prototypes[lang] = prototypes.get(lang, 0) + vectors[i]
    names = sorted(prototypes)
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names])
    got = {r.doc_id: r for r in language_id.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert len(got) == len(rows)
    compared = 0
    for i, t, _ in rows:
        if not plain_trigrams(t or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        cosine = unit @ vectors[i] / max(np.linalg.norm(vectors[i]), 1e-12)
        best = np.sort(cosine)[::-1]
        if best[0] - best[1] > 2e-3:  # the tables hold half-precision numbers
            assert got[i].lang_pred == names[int(cosine.argmax())], (t, cosine)
            compared += 1
            up = np.maximum(cosine, 0)
            assert abs(got[i].score - up.max() / max(up.sum(), 1e-12)) < 0.02
    assert compared > 180
