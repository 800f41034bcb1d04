"""Examples from templates: properties that hold for templates made at random, and each rule of the grammar."""

import random
import re
from collections import Counter

import pytest
from tallyframe.operators import synth as Y

RIVERS = [("Elbe", 4.0), ("Oder", 1.0), ("Po", 0.0)]


def made(body, head="family: river/report", seed=1, others=(), **options):
    main = Y.parse_template("main", f"{head}\n---\n{body}")
    pool = [Y.parse_template(f"part{k}", src) for k, src in enumerate(others)]
    corpus = Y.Corpus([main, *pool], {"river": Y.Gazetteer(RIVERS, alpha=1.0), "level": Y.Gazetteer([(f"{k} cm", 1.0) for k in range(90)])})
    return corpus.render(main, seed, **options)


def texts(body, n=300, **options):
    return [made(body, seed=s, **options)["text"] for s in range(n)]


def test_a_slot_keeps_its_value_and_other_picks_do_not():
    same = [t.split("/") for t in texts("{{pick:level:now}}/{{pick:level:now}}/{{pick:level:then}}")]
    assert all(a == b for a, b, _ in same) and sum(a == c for a, _, c in same) < 30
    assert len({a for a, *_ in same}) > 60


def test_values_come_in_proportion_to_their_weight():
    seen = Counter(texts("{{pick:river}}", 2000))
    assert set(seen) == {"Elbe", "Oder"} and 3 < seen["Elbe"] / seen["Oder"] < 5.3


@pytest.mark.parametrize("low, high", [(0, 0), (3, 3), (2, 40), (999, 1001)])
def test_numbers_stay_within_their_bounds_and_reach_them(low, high):
    numbers = {int(t) for t in texts(f"{{{{int:{low}-{high}}}}}", 600)}
    assert min(numbers) == low and max(numbers) == high
    spaces = {len(t) for t in (made(f"<{{{{pad:{low % 7}-{low % 7 + 4}}}}}>", seed=s)["text"][1:-1] for s in range(200))}
    assert spaces == set(range(low % 7, low % 7 + 5))
    assert all(re.fullmatch(r"\d{5}", t) for t in texts("{{digits:5}}", 50))


@pytest.mark.parametrize("name, undo", [("base64", lambda s: __import__("base64").b64decode(s).decode()), ("hex", lambda s: bytes.fromhex(s).decode()), ("rot13", lambda s: __import__("codecs").encode(s, "rot13"))])
def test_transforms_can_be_undone(name, undo):
    inside = "Pegel ü 7, {{pick:river}}"
    for s in range(20):
        assert undo(made(f"{{{{x:{name}}}}}{inside}{{{{/x}}}}", seed=s)["text"]) == made(inside, seed=s)["text"]


def test_inserting_transforms_only_insert():
    rnd = random.Random(2)
    for name, extra in (("zwsp", "​"), ("noise", " "), ("spaced", " ")):
        source = "".join(rnd.choice("hochwasserÄé7.") for _ in range(400))
        assert Y.TRANSFORMS[name](source, rnd).replace(extra, "") == source
    for name, allowed in (("leet", "4310574hcwrÄé7.9"), ("homoglyph", None)):
        source = "hochwasserAEIOST" * 40
        out = Y.TRANSFORMS[name](source, rnd)
        changed = [(a, b) for a, b in zip(source, out) if a != b]
        assert len(out) == len(source) and len(changed) > 60 and len(set(changed)) == len({a for a, _ in changed})
        assert any(a.isupper() for a, _ in changed) and any(a == b for a, b in zip(source, out) if a in "aeo")


def test_chances_of_optional_parts_and_transforms():
    shown = sum("flood" in t for t in texts("[?f:0.2]flood[/].", 1000))
    assert 140 < shown < 260
    together = texts("[?w]wet[/] and [?w]wet[/]", 100, optional_rate=0.5)
    assert {t.count("wet") for t in together} == {0, 2}
    assert all(t == "dry" for t in texts("dry[?w]wet[/]", 30, optional_rate=0.0))
    loud = sum(t == "HIGH" for t in texts("{{x:upper|p=0.7}}high{{/x}}", 1000))
    assert 620 < loud < 780


def test_alternatives_in_both_forms_are_even():
    for body in ("{{one:up|down|level {{pick:river}}}}", "{{one}}up{{|}}down{{|}}level {{pick:river}}{{/one}}"):
        seen = Counter(t.split(" ")[0] for t in texts(body, 900))
        assert set(seen) == {"up", "down", "level"} and min(seen.values()) > 220


def test_a_block_is_rendered_anew_for_each_of_its_lines():
    seen = set()
    for t in texts("@block gauge\n{{pick:river}} at {{int:0-99}}\n@end\n{{LINES:gauge:2-4}}", 90):
        lines = t.strip().split("\n")
        assert all(re.fullmatch(r"(Elbe|Oder) at \d+", x) for x in lines)
        seen.add((len(lines), len(set(lines)) > 1))
    assert {n for n, _ in seen} == {2, 3, 4} and any(varied for _, varied in seen)


def test_labels_of_what_was_included():
    warning = "family: warn/dam\nweight: 0\nlabel.alarm: true\nlabel.source: dam\n---\nDam at {{pick:level}}."
    seen = set()
    for s in range(200):
        e = made("Calm.{{include:warn/*|p=0.4}}", "family: river/report\nlang: de\nlabel.alarm: false\nlabel.depth: 2.5", s, [warning])
        alarm = "Dam" in e["text"]
        seen.add(alarm)
        assert e["labels"]["alarm"] is alarm and e["labels"]["depth"] == 2.5 and ("source" in e["labels"]) is alarm
        assert e["family"] == "river/report" and e["meta"]["lang"] == "de" and e["meta"].get("includes") == ("warn/dam" if alarm else None)
    assert seen == {True, False}


def test_a_label_that_is_true_stays_true():
    e = made("{{label:alarm=true}}x{{include:quiet}}", others=["family: quiet\nweight: 0\nlabel.alarm: false\n---\ny"])
    assert e["labels"]["alarm"] is True and e["text"] == "xy"


def test_what_stands_before_the_user_is_context():
    e = made("Gauge service.\n{{user}}\nHow high is the {{pick:river}}?")
    assert e["context"] == "Gauge service." and e["text"].startswith("How high is the ")


def _random_template(rnd, depth=0):
    """A body of random valid pieces."""
    make = [lambda: rnd.choice(["calm ", "é ", "]", "a|b "]), lambda: "{{pick:river}}", lambda: "{{pick:level:s%d}}" % rnd.randrange(3), lambda: "{{int:%d-%d}}" % (rnd.randrange(5), 5 + rnd.randrange(5)), lambda: "{{digits:%d}}" % rnd.randrange(1, 9), lambda: "{{label:l%d=%s}}" % (rnd.randrange(3), rnd.choice(["true", "7", "word"]))]
    if depth < 3:
        inner = lambda: _random_template(rnd, depth + 1)
        make += [lambda: "[?o%d:0.5]%s[/]" % (rnd.randrange(3), inner()), lambda: "{{one}}%s{{|}}%s{{/one}}" % (inner(), inner()), lambda: "{{x:%s}}%s{{/x}}" % (rnd.choice(sorted(Y.TRANSFORMS)), inner())]
    return "".join(rnd.choice(make)() for _ in range(rnd.randrange(1, 5)))


def test_random_templates_parse_and_give_the_same_example_for_the_same_seed():
    rnd = random.Random(17)
    for k in range(200):
        body = _random_template(rnd)
        assert made(body, seed=k) == made(body, seed=k)


def test_random_templates_with_one_bracket_lost_do_not_parse():
    rnd = random.Random(18)
    for _ in range(100):
        body = _random_template(rnd)
        ends = [m.start() for m in re.finditer(r"\{\{/(one|x)\}\}", body)]
        if ends:
            at = rnd.choice(ends)
            with pytest.raises(ValueError):
                Y.parse_template("t", "family: f\n---\n" + body[:at] + body[body.index("}}", at) + 2 :])


@pytest.mark.parametrize("source", ["family: f\n---\n{{gauge}}", "family: f\n---\n{{digits:0}}", "family: f\n---\n{{int:8-2}}", "family: f\n---\n[?x:7]y[/]", "family: f\n---\n[?x y", "family: f\n---\n{{x:mirror}}y{{/x}}", "family: f\n---\n{{LINES:gone:1}}", "family: f\n---\nend }}", "family: f\nno rule", "---\nno family", "family: f\nweight: heavy\n---\n", "family: f\n---\n@end"])
def test_sources_that_are_refused(source):
    with pytest.raises(ValueError):
        Y.parse_template("t", source)


def test_rows_do_not_depend_on_how_they_are_dealt(spark):
    corpus = Y.Corpus([Y.parse_template("a", "family: a\n---\n{{pick:river}} {{int:0-999}}"), Y.parse_template("b", "family: b\nweight: 3\n---\n{{int:0-999}}")], {"river": Y.Gazetteer(RIVERS)})
    whole = {r.i: (r.family, r.text) for r in Y.draws(spark, corpus, 0, 400, 5).repartition(7).collect()}
    part = {r.i: (r.family, r.text) for r in Y.draws(spark, corpus, 250, 300, 5).coalesce(1).collect()}
    assert len(whole) == 400 and all(whole[i] == x for i, x in part.items())
    assert 240 < sum(f == "b" for f, _ in whole.values()) < 360
    few = Y.synthesize(spark, corpus, 300, 5, dedupe=True).collect()
    assert len({r.text for r in few}) == len(few) == 300
    with pytest.raises(ValueError):
        Y.synthesize(spark, Y.Corpus([Y.parse_template("a", "family: a\n---\nsame")], {}), 2, dedupe=True)


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep/one.tmpl").write_text("family: x/one\n---\n{{pick:boats}}!")
    (tmp_path / "boats.tsv").write_text("# names\nNixe\t2\n\nÄgir\n")
    rows = Y.synthesize(spark, Y.read_corpus(spark, str(tmp_path)), 80, 2).collect()
    assert {r.text for r in rows} == {"Nixe!", "Ägir!"} and {r.meta["template"] for r in rows} == {"deep/one"}
