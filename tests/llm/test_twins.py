"""Plain twins of the models' inner steps: the PU risk's slopes by finite differences, the language posterior in plain Python."""

import math
from collections import defaultdict

import numpy as np
import pytest

from sitelens.llm import language, quality


def risk(fp, fu, prior):
    """The two parts of the unbiased PU risk with logistic loss: positives as positives, and the rest as negatives."""
    soft = lambda z: np.logaddexp(0, z)
    return prior * soft(-fp).mean(), soft(fu).mean() - prior * soft(fp).mean()


@pytest.mark.parametrize("prior,shift", [(0.4, 0.0), (0.95, 6.0)])
def test_slopes_are_those_of_the_non_negative_risk(monkeypatch, prior, shift):
    """Where the negative part is below zero, the step climbs that part alone (as the method has it); else it goes down the sum."""
    rng = np.random.default_rng(0)
    seen = []
    monkeypatch.setattr(quality.Net, "step", lambda self, z, grad, rate: seen.append((z, grad, [w.copy() for w in self.w])))
    positive, unlabelled = rng.normal(shift, 1, (50, 3)), rng.normal(0, 1, (80, 3))
    if shift:  # an overconfident net: unlabelled rows look negative, positives positive
        normal = np.random.default_rng

        class Strong:
            def __init__(self, seed):
                self.rng = normal(seed)

            def normal(self, mean, dev, shape):
                return np.abs(self.rng.normal(mean, dev, shape)) * 8

            def integers(self, *a):
                return self.rng.integers(*a)

        monkeypatch.setattr(quality.np.random, "default_rng", Strong)
    quality.fit_nnpu(positive, unlabelled, prior, steps=1, size=16)
    z, grad, w = seen[0]
    f = np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]
    down, part = lambda f: sum(risk(f[:16], f[16:], prior)), lambda f: -risk(f[:16], f[16:], prior)[1]
    goal = part if risk(f[:16], f[16:], prior)[1] < 0 else down
    assert (goal is part) == bool(shift)
    for i in range(32):
        e = np.zeros(32)
        e[i] = 1e-5
        assert (goal(f + e) - goal(f - e)) / 2e-5 == pytest.approx(grad[i], abs=1e-7)


def test_backpropagation_equals_finite_differences():
    rng = np.random.default_rng(1)
    net = quality.Net(rng.normal(size=(40, 4)), 6, rng)
    z, slope = rng.normal(size=(9, 4)), rng.normal(size=9)
    before = [w.copy() for w in net.w]
    value = lambda w: float((np.tanh(z @ w[0] + w[1]) @ w[2] + w[3]) @ slope + 0.5e-4 * ((w[0] ** 2).sum() + (w[2] ** 2).sum()))
    net.step(z, slope, 0.0)
    for k, w in enumerate(before):
        for at in np.ndindex(w.shape):
            up, down = ([x.copy() for x in before] for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert (value(up) - value(down)) / 2e-6 == pytest.approx(net.m[k][at] / 0.1, abs=1e-6)


DOCS = [(1, "the cat and the dog in the house", "en"), (2, "le chat et le chien dans la maison", "fr"), (3, "der hund und die katze im haus", "de"), (4, "the end of the day", "en"), (5, None, "fr"), (6, "", "en"), (7, "no language", None)]
PAGES = [(1, "http://a.example.com/en/1", '<html lang="en"><p>the dog and the cat</p>'), (2, "http://a.example.com/fr/2", '<html lang="fr"><p>le chien et la maison</p>'), (3, "http://b.example.com/x", "<p>die katze und der hund</p>"),
         (4, "http://c.site.fr/", "<html lang=en>le chat dans la maison"), (5, None, None), (6, "http://a.example.com/en/1", ""), (6, "no url", "the <script>die katze</script> day"), (None, "http://d.site.fr/y", '<html lang="xx">123')]


def test_language_posterior_equals_plain_python(spark):
    docs = spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, lang string, page_id string")
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, lang string").repartition(3)
    parsed = [r.asDict() for r in language.parse(pages).collect()]

    def buckets(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return language.trigrams(raw, np.array([0, len(raw)]))[1].tolist()

    counts = defaultdict(lambda: defaultdict(int))
    for _, text, lang in DOCS:
        for b in buckets(text) if lang else []:
            counts[lang][b] += 1
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    size, smooth = language.BUCKETS, language.SMOOTH
    for r in parsed:
        own = buckets(r["text"])
        ll = [sum(math.log((counts[x][b] + 0.5) / (total[x] + 0.5 * size)) for b in own) * min(len(own), language.TEMPER) / max(len(own), 1) for x in langs]
        r["ll"] = [v - max(ll) for v in ll]
        e = [math.exp(v) for v in r["ll"]]
        r["soft"] = [v / sum(e) for v in e]
    n = range(len(langs))
    mass = [1 + sum(r["soft"][i] for r in parsed) for i in n]
    base = [m / sum(mass) for m in mass]

    def by(column, value):
        return [sum(r["soft"][i] for r in parsed if r[column] == value) for i in n]

    def share(v):
        return [x / sum(v) for x in v]

    want = []
    for r in parsed:
        rest = lambda c: [max(x - y, 0.0) for x, y in zip(by(c, r[c]), r["soft"])] if r[c] is not None else [0.0] * len(langs)
        site = share([x + smooth * b for x, b in zip(rest("site"), base)])
        prior = share([x + smooth * b for x, b in zip(rest("host"), site)])
        logs = [math.log(prior[i]) + r["ll"][i] for i in n]
        for c in ("declared", "suffix"):
            if r[c] is not None:
                logs = [logs[i] + math.log((by(c, r[c])[i] + smooth * 0.02) / (mass[i] + smooth)) for i in n]
        p = share([math.exp(v - max(logs)) for v in logs])
        want.append((r["page_id"], r["host"], langs[p.index(max(p))], max(p)))
    order = lambda rows: sorted(rows, key=repr)
    got = [(r["page_id"], r["host"], r["lang"], r["posterior"]) for r in language.identify(pages, docs).collect()]
    assert len(got) == len(want)
    for g, w in zip(order(got), order(want)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-6)
