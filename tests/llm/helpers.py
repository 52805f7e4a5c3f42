"""Brute-force versions of the operators."""

from __future__ import annotations

from collections import Counter

from gradeline.llm import words


def similarity(a: str, b: str) -> float:
    x, y = Counter(words.words(a)), Counter(words.words(b))
    common = sum((x & y).values())
    return common / (sum(x.values()) + sum(y.values()) - common) if x and y else 0.0


def near_pairs(rows: list[tuple[str, str]], least: float = 0.6) -> set[tuple[str, str]]:
    return {(i, j) for i, s in rows for j, t in rows if i < j and s and t and similarity(s, t) >= least - 1e-12}


def repeated_share(text: str, run: int = 4) -> float:
    from gradeline.llm.repetition import bare

    w = [x for x in map(bare, text.split()) if x]
    marked = set()
    for i in range(len(w) - run + 1):
        if any(w[j : j + run] == w[i : i + run] for j in range(i)):
            marked |= set(range(i, i + run))
    return len(marked) / len(w) if w else 0.0


def texts_like(n: int, seed: int, vocabulary: int = 400, length: int = 40) -> list[str]:
    """Texts of random words, some of them edited copies of others."""
    import random

    r = random.Random(seed)
    out: list[str] = []
    for _ in range(n):
        if out and r.random() < 0.4:
            w = r.choice(out).split()
            for _ in range(r.randint(0, len(w) // 2)):
                k = r.randrange(len(w))
                how = r.random()
                w[k : k + 1] = [] if how < 0.3 and len(w) > 5 else [f"ש{r.randrange(vocabulary)}"] if how < 0.7 else [w[k], f"ב{r.randrange(vocabulary)}"]
            if r.random() < 0.3:
                r.shuffle(w)
        else:
            w = [f"מ{min(r.randrange(vocabulary), r.randrange(vocabulary))}" for _ in range(r.randint(length // 2, length))]
        out.append(" ".join(w))
    return out
