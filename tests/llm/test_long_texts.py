"""A very long text is read block by block: same results as of its blocks taken whole, and bounded memory."""

import random
import subprocess
import sys

import numpy as np
import pytest

from tidemark.llm import common, langid, licenses, simhash, toxicity, weaklabels
from tidemark.operators import nearsets

CODE = """
import resource, sys
import numpy as np
from tidemark.llm import langid, licenses, simhash, toxicity, weaklabels
text = ("The cat sat on the mat; le chat est là. You foul wretch! word and the of in this is lorem\\n" * 300_000)[: 20_000_000]
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
what = sys.argv[1]
if what == "langid":
    langid.gram_counts(text)
elif what == "licenses":
    licenses.scan(text + licenses.templates()["MIT"][-1], licenses.build_index(licenses.templates()))
elif what == "simhash":
    simhash.fingerprint(text, 3)
elif what == "toxicity":
    toxicity._sentences(text, toxicity._Known(toxicity.bucket))
else:
    weaklabels.votes(weaklabels.facts(text))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1000)
"""


@pytest.mark.parametrize("what, most", [("langid", 300), ("licenses", 450), ("simhash", 300), ("toxicity", 400), ("weaklabels", 300)])
def test_memory_of_a_long_text(what, most):
    out = subprocess.run([sys.executable, "-c", CODE, what], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < most, out.stdout  # MB over the text itself; whole lists of its words or n-grams take 1,000 and more


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(2)
    words = ["alpha", "Beta!", "GAMMA", "d.", "e?\n", "|", "###", "straße", "x\x1cy", "  ", "\n\n", "said so"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + licenses.templates()["ISC"][0] * rng.randint(0, 1) for _ in range(60)]
    index = licenses.build_index(licenses.templates())
    known = weaklabels._Known()

    def all_of(text):
        grams, n = langid.gram_counts(text)
        ids, sentence = toxicity._sentences(text, toxicity._Known(toxicity.bucket))
        at, x = weaklabels.features(text, known)
        return [grams.tolist(), n.tolist(), licenses.scan(text, index), simhash.fingerprint(text, 3), ids.tolist(), sentence.tolist(), weaklabels.votes(text), dict(zip(at.tolist(), np.round(x, 9).tolist())), nearsets.shingle_set(text, 5).tolist()]

    whole = [all_of(t) for t in texts]
    monkeypatch.setattr(common, "BLOCK_CHARS", 11)
    monkeypatch.setattr(langid, "COUNT_CHARS", 13)
    monkeypatch.setattr(licenses, "WORDS_AT_ONCE", 7)
    blocks = nearsets.hash_blocks
    for module in (nearsets, simhash):
        monkeypatch.setattr(module, "hash_blocks", lambda text, n: blocks(text, n, 9))
    assert [all_of(t) for t in texts] == whole
    assert all("".join(common.text_blocks(t)) == t for t in texts)
    spec = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    from tidemark.llm import bpe

    library, own = Tokenizer.from_file(spec), bpe.Codec(spec)
    assert [own.encode(t).tolist() for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_templates_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"Head. {t} Tail.") for k, t in enumerate([licenses.templates()["ISC"][0], licenses.templates()["BSD-3-Clause"][1], "nothing"])] + [(None, "Released under the MIT License")], "doc_id bigint, text string")
    whole = sorted(map(str, licenses.scan_documents(docs).collect()))
    monkeypatch.setattr(licenses, "MOST_FINGERPRINTS", 300)
    assert len(licenses.index_parts(licenses.templates(), 3, 2)) > 5
    assert sorted(map(str, licenses.scan_documents(docs).collect())) == whole and len(whole) == 3


def test_languages_by_join(spark, odd, monkeypatch):
    profiles = langid.learn_profiles(odd)
    whole = sorted(map(str, langid.predict(odd, profiles).collect()))
    with monkeypatch.context() as m:
        m.setattr(langid, "MOST_LANGUAGES", 0)
        assert sorted(map(str, langid.predict(odd, profiles).collect())) == whole
    monkeypatch.setattr(langid, "MOST_CELLS", 0)
    assert sorted(map(str, langid.predict(odd, profiles).collect())) == whole


def test_a_long_text_through_whole_operators(spark):
    """4 MB of different words in one row: removal, rules, tokens and packing take it as any other."""
    import public_tokenizers

    from tidemark.llm import bpe, packing, quality, substrings

    text = " ".join(f"w{k * 2654435761 % 999983}x" for k in range(450_000))
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, text[: 1 << 20], "en", "s"), (3, "short text", "en", "s")], "doc_id bigint, text string, lang string, source string")
    removed = {r.id: (r.n_bytes, r.n_removed) for r in substrings.remove_repeats(docs).collect()}
    assert removed == {1: (len(text), 1 << 20), 2: (1 << 20, 1 << 20), 3: (10, 0)}
    judged = {r.id: (r.n_words, r.base_failed) for r in quality.judge(docs.where("doc_id <> 2")).collect()}
    assert judged == {1: (450_000, False), 3: (2, True)}
    told = bpe.encode(docs.where("doc_id = 1"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True).first()
    assert told.text == text and len(told.ids) > 450_000
    pieces = packing.pack_documents(docs.where("doc_id <> 2"), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(p.length for p in pieces if p.doc_id == 1) > 450_000 and max(p.length for p in pieces) == 4096
