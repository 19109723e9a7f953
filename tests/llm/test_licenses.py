"""Op 10: planted templates are found, exactly those that brute force over
the same windows finds."""

import random
import re

from subscope.llm import licenses
from tests.llm.helpers import docs, words


def tokens(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[0-9]", "0", (text or "").lower()))


def plain(text):
    out = set()
    t = tokens(text)
    sh = [tuple(t[i:i + 5]) for i in range(len(t) - 4)]
    for name, template in licenses.TEMPLATES.items():
        q = tokens(template)
        own, size = {tuple(q[i:i + 5]) for i in range(len(q) - 4)}, 1 << (len(q) - 1).bit_length()
        for at in range(0, len(sh), size):
            if len(own & set(sh[at: at + 2 * size])) >= 0.8 * len(own):
                out.add(name)
    return out


def test_finds_what_brute_force_finds(spark):
    rng, rows = random.Random(7), []
    for i in range(150):
        name, template = rng.choice(sorted(licenses.TEMPLATES.items()))
        toks = template.split()
        if rng.random() < 0.4 and len(toks) > 12:
            toks[rng.randrange(len(toks))] = "changed"
        before, after = words(rng, rng.randrange(0, 300)), words(rng, rng.randrange(0, 100))
        rows.append((i, f"{before}\n{rng.choice([str, str.upper])(' '.join(toks))}\n{after}"))
    rows += [(200 + i, words(rng, 200)) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "a b"), (303, "é" * 9000), (304, "Licensed under CC BY-NC 9.1!")]
    hits = licenses.license_hits(docs(spark, rows).repartition(4))
    got = {(r.doc_id, r.license) for r in licenses.licenses_by_document(hits).collect()}
    assert got == {(i, n) for i, t in rows for n in plain(t)} and len(got) > 120
    text = dict(rows)
    for r in hits.collect():
        passage = text[r.doc_id].lower().encode()[r.start_byte: r.end_byte].decode()
        assert tokens(passage)[:1] and (tokens(passage)[0] in tokens(licenses.TEMPLATES[r.license]))


def test_short_notices_are_found_wherever_they_stand():
    import pyarrow as pa

    rng, texts = random.Random(11), []
    # how easily a MinHash misses a notice depends on its hash: many notices of 5 to 11 words
    notices = {f"n{i}": " ".join(f"n{i}x{chr(97 + j)}" for j in range(5 + i % 7)).translate(
        str.maketrans("0123456789", "qrstuvwyzk")) for i in range(300)}
    for i, text in enumerate(notices.values()):
        for head, tail in ((0, 60), (60, 60), (60, 0)):
            texts += [(f"n{i}", f"{words(rng, head)}\n{text}\n{words(rng, tail)}") for _ in range(3)]
    found = {x[:2] for x in licenses._scan(
        pa.array([t for _, t in texts]), licenses.groups_of(notices, 5), 5, 0.8)}
    assert [(i, n) for i, (n, _) in enumerate(texts) if (i, n) not in found] == []


def test_bands_follow_the_least_likeness():
    for words_of in (12, 16, 17, 32, 33, 64, 65, 300):
        text = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(words_of))
        (g,) = licenses.groups_of({"x": text}, 5)
        s = words_of - 4
        need = -(-4 * s // 5)
        assert (1 - need / (2 * g.words + s - need)) ** len(g.minima) <= 1e-6


def test_empty_and_repeated(spark):
    assert licenses.license_hits(docs(spark, [])).count() == 0
    d = docs(spark, [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, None)])
    got = licenses.licenses_by_document(licenses.license_hits(d)).collect()
    assert [(r.doc_id, r.license, r.containment) for r in got] == [(1, "mit-notice", 1.0)]
