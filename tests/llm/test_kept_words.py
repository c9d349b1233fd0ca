"""What a worker keeps of restored words from task to task."""

import pickle

from momentloom.llm import quality, toxicity
from momentloom.llm.common import free_caches


def test_a_worker_keeps_one_restorer_for_its_letters():
    letters = toxicity.CharacterModel({5: 3, 70: 1})
    first = toxicity.restorer_of(pickle.loads(pickle.dumps(letters)))
    first.word("a1b")
    assert toxicity.restorer_of(pickle.loads(pickle.dumps(letters))) is first and "a1b" in first.known
    other = toxicity.restorer_of(toxicity.CharacterModel({5: 4}))
    assert other is not first and not other.known and len(toxicity._restorers) == 1
    free_caches()
    assert not toxicity._restorers


def test_words_of_several_texts_are_encoded_in_one_call(monkeypatch):
    paths = quality._paths(quality.VOCABULARIES)
    own, plain = quality.Fertility(paths), quality.Fertility(paths)
    texts = [dict(quality.counted(t)[0]) for t in ("alpha beta beta", "", "gamma " + "z" * 70 + " beta", "δέλτα alpha")]
    calls = []
    encode = own.ids
    monkeypatch.setattr(own, "ids", lambda words: calls.append(words) or encode(words))
    assert own.measures_of(texts, [14, 0, 79, 10]) == [tuple(plain.measures(t, n)) for t, n in zip(texts, [14, 0, 79, 10], strict=True)]
    assert [sorted(c) for c in calls] == [["alpha", "beta", "gamma", "z" * 70, "δέλτα"]]


def test_frequent_words_stay_known(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE", 4)
    worked = []
    restore = toxicity.restore
    monkeypatch.setattr(toxicity, "restore", lambda word, model: worked.append(word) or restore(word, model))
    own = toxicity.Restorer(toxicity.CharacterModel({5: 3, 70: 1}))
    found = {own.word("letter") for k in range(40) if own.word(f"w{k}") is not None}
    assert len(found) == 1 and worked.count("letter") == 1 and len(own.known) <= 4 >= len(own.before)
