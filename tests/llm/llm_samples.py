"""Small tables with every awkward case: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, bucket int, hot boolean, kept string"


def awkward_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij é", k=rng.randint(2, 9))).strip() or "a" for _ in range(300)]
    base = [" ".join(rng.choices(words, k=70)) for _ in range(6)]
    rows: list[tuple[int | None, str | None]] = [
        (0, ""), (1, None), (2, "x" * 49), (3, "x" * 50), (4, "x" * 700), (5, "ab" * 400), (6, "one two"), (7, "one two"),
        (8, " \t\n"), (9, "A b C d E f"), (10, "a B c D e F"), (None, base[0]), (None, None), (None, "x" * 60),
    ]
    for i in range(20, 160):
        text = " ".join(rng.choices(words, k=rng.randint(0, 40)))
        if i % 2:
            part = rng.choice(base)
            at = rng.randint(0, len(part) - 60)
            text += " " + part[at : at + rng.randint(45, 200)] + " " + text[:20]
        if i % 7 == 0:
            text = base[i % 6]
        if i % 11 == 0:
            changed = base[i % 6].split()
            changed[i % len(changed)] = "changed"
            text = " ".join(changed)
        if i % 5 == 0:
            text += base[0]
        rows.append((i, text))
    rows.append((200, " ".join(rng.choices(words, k=6000))))  # long
    rows += [rows[20], rows[21]]  # repeated rows
    return rows


def awkward_docs(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    full = [
        (i, t, None if k % 9 == 0 else "en", None if k % 4 == 0 else f"src{k % 3}", None, 1, 2, True, "x")
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)
