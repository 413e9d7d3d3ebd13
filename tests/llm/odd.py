"""Small tables with nulls, empty and very long texts, ties, repeats and clashing columns."""

import random
import re

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, node string, block int, bucket int, score double, label string, c0 string, key string, _row int"


def word(g):
    return "".join(g.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(g.randint(1, 4)))


def prose(g, n):
    return " ".join(word(g) for _ in range(n))


def rows(seed=1):
    g = random.Random(seed)
    base = prose(g, 120)
    passage = prose(g, 70)
    texts = ["", None, "   \n\t ", "one", "a b c d", "1234 !!", base, base, base + " more words", prose(g, 60) + " " + passage + " " + prose(g, 60), prose(g, 50) + " " + passage, prose(g, 9000), "é" * 300 + " ß" * 200, "Été " * 120, "x" * 5000, "The quick Brown fox. <|endoftext|> it's ΣΑΣ"]
    for _ in range(40):  # a crowd of near copies
        w = base.split()
        w[g.randrange(len(w))] = word(g) + "q"
        texts.append(" ".join(w))
    texts += [prose(g, g.randint(1, 40)) for _ in range(25)]
    out = [(i, t, None if i % 9 == 0 else ["en", "fr"][i % 2], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[6], out[6], (out[9][0], "another text of a known id", "en", "s", 1), (None, "a text without an id", "en", "s", 1), (None, None, None, None, None)]
    g.shuffle(out)
    return out


def frame(spark, data=None, parts=3):
    data = rows() if data is None else data
    full = [(*r, 1, "r", "n", 2, 3, 0.5, "l", "c", "k", 4) for r in data]
    return spark.createDataFrame(full, COLUMNS).repartition(parts)


def words(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", raw)
