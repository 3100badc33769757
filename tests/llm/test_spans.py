"""Guess costs against an enumeration, and spans of planted values that no template of the operators wrote."""

import itertools
import random
import re
from functools import lru_cache

import pytest

from codaria.llm.guesses import guess_bits, segments, word_ranks
from codaria.llm.pii import pii_spans, redact, trained
from codaria.llm.secret_scan import SecretConfig, base_matches, secret_spans


def test_cost_is_the_least_of_all_segmentations():
    rng = random.Random(3)
    ranks = {"pass": 1, "word": 2, "password": 9, "sword": 4}
    for _ in range(150):
        value = "".join(rng.choice(["pass", "word", "s", "1", "2", "12", "Q", "we", "$", "1999", " "]) for _ in range(rng.randint(0, 5)))[:11]
        found = list(segments(value, ranks))

        @lru_cache(maxsize=None)
        def every(at, value=value, found=found):
            """The cost of each segmentation from here on."""
            return [0.0] if at == len(value) else [b + rest for s, e, b in found if s == at for rest in every(e)]

        assert guess_bits(value, ranks) == pytest.approx(min(every(0)))


def test_segments_are_what_they_are_called():
    found = {(s, e): b for s, e, b in segments("Dragon2019-12-31qwertabab", word_ranks())}
    assert {(0, 6), (6, 16), (16, 21), (23, 25)} <= set(found)
    assert all(found[x] < 6 * (x[1] - x[0]) for x in ((0, 6), (6, 16), (16, 21)))


def test_dictionary_of_a_vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = word_ranks(path)
    assert len(ranks) > 10_000 and ranks["password"] == 1
    cfg = SecretConfig(vocabulary=path)
    plain = ["auth: development", "token: environment", "secret = communication", 'password: "your password here"', "pwd: changeme", "credentials: unavailable", "auth = disabled", "passphrase: required"]
    strong = ['pwd: "kq7!vZ2#pL9x"', "auth=9fK2-mQ7x-Vb31", 'passphrase: "correct horse battery staple zebra"', "credential: Zx#81kd!qPw", "bearer: tR8$kLm02@vbn", "auth: Bearer q8Zr2VvK0pLx9TtB", "private key = 7Gh!2kQz0Pw", "pwd: aB3$x_9Kq"]
    assert [t for t in plain if any(s.added for s in secret_spans(t, cfg))] == []
    assert [t for t in strong if not any(s.added for s in secret_spans(t, cfg))] == []


def test_base_secrets_are_those_of_the_patterns():
    rng = random.Random(8)
    pieces = ["password", "PassWd", "api_key", "apikey", "token", "secret", '"', "'", " ", ":", "=", "AKIA", "ABCDEF0123456789", "deadbeef" * 3, "0123abcd" * 2, "x", "\n", "Zz9+/_.=-", "é", "ſecret"]
    kinds = {"assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}
    for _ in range(600):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        want = {(m.start(), m.end(), k) for k, (p, g, n) in kinds.items() for m in re.finditer(p, text, re.ASCII) if len(m.group(g)) >= n}
        assert {(s.start, s.end, s.kind) for s, _ in base_matches(text)} == want


# Sentences with the personal data that a reader would redact between braces.
WITH = """You can reach me on {(020) 7946-0958} after six.
My mobile is {07700 900 123}, leave a message.
Please phone {415-555-0132} to confirm the booking.
Ring {030 901820 55} if the door is locked.
Her telephone: {555-867-5309} and she is at work now.
Mail {jane.doe [at] example [dot] org} for the slides.
contact {bob(at)uni-jena(dot)de} with questions
Write to {sales[at]shop.example.com} today.
The server address is {2001:0db8:85a3:0000:0000:8a2e:0370:7334} tonight.
His social security number is {078-05-1120}, keep it safe.
Transfer it to IBAN {DE89370400440532013000} by Friday.
Our IBAN: {GB82 WEST 1234 5698 7654 32} thanks
Call {212 555 0199} now.
Her account number GB33BUKB20201555555555 was closed.
tel. {01 42 68 53 00} ou par courrier
Fax {(0211) 555-7788} every morning.""".split("\n")
WITHOUT = """The order number 2023-11-05 shipped on 12.11.2023 in version 10.2.
Invoice 4711-0815 lists 12 500 items and a total of 1 234 567 units.
ISBN 978-3-16-148410-0 is out of print since 2001-2004.
Chapter 3.4.1 covers pages 100-120 of part 7.
Serial 123456789012 was replaced by build 20230405.
The score was 3 - 2 after 90 minutes and 30 000 people saw it.
He was born in 1984 and moved in 2003.
Meet @ 10.30 or @ 11.15 in room 4.
At 12:30:45:10:20:30:40:50 the clock stopped.
Tracking id 9400 1000 0000 0000 0000 00 arrived.""".split("\n")


def test_added_personal_data_on_sentences_of_another_hand():
    model = trained()
    right = wrong = missed = 0
    for line in itertools.chain(WITH, WITHOUT):
        m = re.search(r"\{(.*)\}", line)
        text = line.replace("{", "").replace("}", "")
        spans = pii_spans(text, model)
        want = (m.start(), m.end() - 2) if m else None
        got = {(s.start, s.end) for s in spans}
        right += want in got
        missed += want is not None and want not in got
        wrong += len(got - {want})
    print("right", right, "wrong", wrong, "missed", missed)
    assert right / (right + missed) >= 0.7 and right / (right + wrong) >= 0.7


def test_probabilities_of_base_spans_and_extensions():
    spans = pii_spans("please call +49 (30) 1234-567 or mail a.b@c.org", trained())
    assert [s.kind for s in spans if not s.added] == ["email", "phone"] and all(0 < s.score < 1 for s in spans)
    assert redact("mail a@b.c now", pii_spans("mail a@b.c now", trained())) == "mail [EMAIL] now"
