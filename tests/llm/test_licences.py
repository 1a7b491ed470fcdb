import textwrap

import pytest
import regex

from tessera.llm import licences


@pytest.fixture(scope="module")
def model(sample):
    return licences.train(licences.placed_pairs(licences.sentences(sample)))


def brute(text, model):
    """status, family, families and number of notices of one text, sentence by sentence in plain Python."""
    best, families, n = None, set(), 0
    for s in licences.sentences_of(text):
        if not regex.search(licences.GATE, s.lower()):
            continue
        family, chance = licences.score_of(s, model)
        if family == licences.OTHER:
            continue
        n += 1
        sure = chance >= licences.SURE
        confirmed = sure and licences.agreement_of(s, family) >= licences.AGREE
        rank = (confirmed, sure, chance, family if sure else "unknown")
        best = max(best or rank, rank)
        if confirmed:
            families.add(family)
    status = "none" if best is None else "confirmed" if best[0] else "predicted" if best[1] else "unknown"
    return status, best and best[3], ",".join(sorted(families)), n


def check(frame, texts, model):
    rows = {r.doc_id: r for r in licences.report(frame(texts), model).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.status, r.family, r.families or "", r.n_paragraphs) == brute(t, model), t
    return rows


def test_against_brute_force(frame, model, sample):
    templates = [t for all_of in licences.TEMPLATES.values() for t in all_of]
    texts = ["", None, "plain prose", "MIT", *templates, *(" ".join(p) for p in zip(templates, templates[5:], strict=False)), *(f"# {t}\n\n{t.upper()}\r\n \r\n* x" for t in templates)]
    texts += [t.format(n) for t in licences.TALK for n in licences.NAMES[:4]] + ["the license " * 30_000, "word " * 100_000 + templates[3], *(" ".join(t.split()[::2]) for t in templates)]
    check(frame, texts + [r.text for r in sample.collect()], model)


def test_wrapped_notices_of_all_families_are_confirmed(frame, model):
    names, texts = zip(*[(f, s) for f, parts in licences.PARTS.items() for s in parts], strict=True)
    for prefix in ("", " * ", "# "):
        wrapped = ["Some prose here.\n\n" + "\n".join(prefix + line for line in textwrap.wrap(t, 30, break_on_hyphens=False, break_long_words=False)) + "\n\nMore prose." for t in texts]
        rows = check(frame, wrapped, model)
        assert [(t, rows[i].family) for i, t in enumerate(texts) if rows[i].status != "confirmed" or names[i] not in rows[i].families.split(",")] == []


def test_talk_about_licences_is_not_confirmed(frame, model):
    texts = ["We compare the MIT License with other licenses.", "The Apache License is popular.", "prose", "A fishing license was lost near the lake yesterday.", "Copyright law matters to authors in many lands.", "mit der Lizenz"]
    texts += [t.format(n) for n in licences.NAMES for t in ("She wrote a book on the {}.", "Why did they leave the {} behind?", "In the year 2000 the {} was not yet known here.")]
    rows = check(frame, texts, model)
    assert [texts[i] for i in rows if rows[i].status == "confirmed"] == []
    assert sum(r.status != "none" for r in rows.values()) <= len(texts) // 10


def test_the_gate_loses_nothing(model):
    """A sentence without a feature belongs to no family, and the gate finds each that has one."""
    weights, bias, names, _ = model
    assert all(bias[-1] > b for b in bias[:-1]) and names[-1] == licences.OTHER
    for p in licences.FEATURES:
        a, b = p.split()
        for s in (p, f"x {a}, {b} y", f"{a}\t({b})"):
            assert regex.search(licences.GATE, s)
            assert p in licences.pairs_of(s)
    assert not regex.search(licences.GATE, "of the people and their houses")


def test_several_and_repeated(frame, model):
    both = "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."
    rows = licences.report(frame([(1, both), (1, both), (2, both), (None, both)]), model).collect()
    assert len(rows) == 4
    assert {(r.status, r.families, r.n_paragraphs) for r in rows if r.doc_id} == {("confirmed", "apache-2.0,mit", 2)}
    assert licences.report(frame([]), model).collect() == []
    assert licences.train(licences.placed_pairs(licences.sentences(frame([]))))[2][-1] == licences.OTHER


def test_notices_in_the_data(sample, model):
    known = {"gpl": "GNU General Public License", "mit": "MIT License", "apache-2.0": "Apache License", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved"}
    texts = {r.doc_id: r.text for r in sample.collect()}
    for r in licences.report(sample, model).collect():
        assert (r.families or "") == ",".join(sorted(f for f, s in known.items() if s.lower() in texts[r.doc_id].lower()))


def test_no_python_on_the_main_path(sample, model):
    plan = licences.report(sample, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
