"""Small documents with every odd case, and brute-force helpers."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def prose(rng, lines=6, per_line=14):
    return "\n".join(" ".join(words(rng, per_line)).capitalize() + "." for _ in range(lines))


def corpus(seed=1, n=40):
    """Unique texts, exact and near copies, shared and near lines, nulls, blanks, a long text."""
    rng = random.Random(seed)
    texts = [prose(rng) for _ in range(n)]
    shared = " ".join(words(rng, 20))
    near = shared.split()
    near[7] = "other"
    texts[3] += "\n" + shared
    texts[5] += "\n" + " ".join(near)
    texts[8] += "\n" + shared + "\n" + " ".join(near + ["more"])
    copy = texts[1].split(" ")
    copy[10] = "changed"
    again = list(copy)
    again[60] = "twice"
    texts += [texts[0], texts[0], " ".join(copy), " ".join(again), None, "", " \n\t ", "one", "one", "two words",
              "12 34 --", " ".join(words(rng, 3000)), "Ünï çödé ß 漢字 " * 5]
    sources = ["b", "a", None, "c", "b", "b"]
    return [(i, t, rng.choice(["en", "de", None]), sources[i % 6], None if t is None else len(t)) for i, t in enumerate(texts)]


def reachable(ids, links):
    """Smallest id reachable of every id."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label
