import random
import re
from collections import Counter, defaultdict

from cuelake.functions.text import indel
from cuelake.operators.name_drift import name_drift_findings, occurrences

ENDED = re.compile(r"[.!?][\"'»“”„’\)\]]*\s*$")


def marks(cues):
    """(token, whether it begins a sentence) of an episode's texts in order."""
    out, fresh = [], True
    for text in cues:
        text, at = " ".join(x.strip(" ") for x in (text or "").split("\n") if x.strip(" ")), 0
        for m in re.finditer(r"\w+", text):
            fresh = fresh or bool(ENDED.search(text[at : m.start()]))
            out.append((m.group(), fresh))
            fresh, at = False, m.end()
        fresh = fresh or bool(ENDED.search(text[at:]))
    return out


def brute(source, output):
    """(ep, kind, cue_ids, old, new) by all pairs within each episode."""
    out = set()
    for ep in output:
        said = marks(t for _, t in source.get(ep, []))
        n, forms, names = Counter(t.casefold() for t, _ in said), defaultdict(Counter), set()
        for t, fresh in said:
            forms[t.casefold()][t] += 1
            if t[0].isupper() and not fresh:
                names.add(t.casefold())
        seen = defaultdict(list)
        for cue, text in output[ep]:
            for t, _ in marks([text]):
                seen[t.casefold()].append((t, cue))
        for key, places in seen.items():
            if key in forms or len(key) < 4:
                continue
            near = [(n[k], indel(key, k), -i, k) for i, k in enumerate(forms) if n[k] >= 2 and abs(len(k) - len(key)) <= 3 and indel(key, k) >= 70]
            if near and max(near)[0] / sum(x[0] for x in near) >= 0.8:
                old = max(near)[3]
                kind = "name_spelling_inconsistency" if old in names else "unsourced_word_substitution"
                out.add((ep, kind, tuple(sorted({c for _, c in places})), forms[old].most_common(1)[0][0], places[0][0]))
    return out


def frame(spark, sides):
    rows = [(ep, pos, cue, text) for ep, cues in sides.items() for pos, (cue, text) in enumerate(cues)]
    return spark.createDataFrame(rows, "ep long, pos long, cue_id long, text string")


def test_equals_all_pairs_within_each_episode(spark):
    r = random.Random(7)
    make = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 11)))
    base = [make() for _ in range(60)] + ["straße", "kate", "philip"]
    drift = lambda w: "".join(r.choice([c, c, c, c, c, "", c + "k", "q"]) for c in w) or "x"
    case = lambda w: r.choice([w, w.capitalize()])
    text = lambda of: "".join(case(w) + r.choice([" ", " ", ". ", '!" ', "\n", ", "]) for w in of)
    source = {ep: [(i + 1, r.choice([None, text(r.choices(base, k=8)), text(r.choices(base, k=8))])) for i in range(12)] for ep in range(6)}
    output = {ep: [(i + 1, text(map(drift, r.choices(base, k=8)))) for i in range(12)] for ep in range(7)}
    got = [(x.ep, x.kind, tuple(x.cue_ids), x.old_text, x.new_text) for x in name_drift_findings(frame(spark, source), frame(spark, output)).collect()]
    assert len(got) == len(set(got)) > 60 and set(got) == brute(source, output) and {x[1] for x in got} == {"name_spelling_inconsistency", "unsourced_word_substitution"}


def test_an_episode_neither_hides_nor_explains_another(spark):
    deanna = [(1, "Ich sehe Deanna."), (2, "Ich kenne Deanna.")]
    source, output = frame(spark, {1: deanna, 2: [(1, "Ich sehe Diana.")]}), frame(spark, {1: [(1, "Ich sehe Diana.")], 2: [(1, "Ich sehe Deanna.")]})
    rows = name_drift_findings(source, output).collect()
    assert [(x.ep, x.kind, x.cue_ids, x.severity) for x in rows] == [(1, "name_spelling_inconsistency", [1], "warning")]
    assert rows[0].message == "Output spelling 'Diana' is absent from the source, while near spelling 'Deanna' appears 2 times; review as a possible name drift."


def test_sentences_go_on_over_cues_and_empty_ones(spark):
    cues = {1: [(1, "Ich sehe"), (2, "Deanna."), (3, None), (4, "..."), (5, 'Ich kenne "Ende!"'), (6, "Deanna")]}
    got = {(x.cue_id, x.i): x.initial for x in occurrences(frame(spark, cues)).collect()}
    assert got == {(1, 0): True, (1, 1): False, (2, 0): False, (5, 0): True, (5, 1): False, (5, 2): False, (6, 0): True}


def test_empty_sides(spark):
    none = frame(spark, {1: [(1, None)]})
    assert name_drift_findings(none, frame(spark, {1: [(1, "Deanna")]})).count() == 0 == name_drift_findings(frame(spark, {1: [(1, "Deanna Deanna")]}), none.where("false")).count()


def test_letters_of_words_are_not_broadcast(spark, sf):
    from cuelake.plans.queries import QUERIES

    plan = QUERIES["name_drift_roles"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_dictionary_is_counted_once(spark, sf):
    from cuelake.plans.queries import QUERIES

    assert "documents.parquet" not in QUERIES["name_drift"](spark, sf)._jdf.queryExecution().executedPlan().toString()
