"""Array files cut by many tasks: the rows and counters of files read as a whole."""

import json
import random

import numpy as np
import pytest

from logrung.sources.files import load_counters, scan_json
from logrung.sources.json_arrays import _Lexer


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_quotes_and_depth_against_a_plain_reading(size):
    rng = random.Random(size)
    for _ in range(300):
        text = "".join(rng.choices(['"', "\\", "[", "]", "{", "}", ",", "a", "é"], k=rng.randint(0, 40))).encode()
        want, inside, escaped, depth = [], False, False, 0
        for b in text:
            c = chr(b)
            quote = c == '"' and not escaped
            outside = not inside and not quote
            escaped = c == "\\" and not escaped
            inside ^= quote
            depth += (c in "[{") - (c in "]}") if outside else 0
            want.append((outside, depth))
        lexer, got = _Lexer(), []
        for at in range(0, len(text), size):
            outside, level = lexer.feed(np.frombuffer(text[at : at + size], np.uint8))
            got += list(zip(outside.tolist(), level.tolist(), strict=True))
        assert got == want, text


def _value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, 1, -2.5, "", "]", "},{", '"', "\\", "a\\\"b", "[é\U0001f600", "\n\t"])
    if kind < 4:
        return "".join(rng.choices('ab"\\[]{}, é', k=rng.randint(0, 12)))
    if kind == 4:
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}": _value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("arrays")
    rng = random.Random(3)
    for i in range(2):
        items = [_value(rng) if rng.random() < 0.3 else {"line": _value(rng), "n": k} for k in range(12)]
        (root / f"good{i}.json").write_text(json.dumps(items, ensure_ascii=i % 2 == 0, indent=[None, 1, 0][i]))
    texts = {
        "empty": " [ \n ] ", "nothing": "", "blank": "  \n", "one": '[{"a": 1}]', "plain": "[1, 2, 3]", "object": '{"a": [1, 2]}',
        "cut": '[{"a": 1}, {"b": ', "open": '[{"a": 1}', "tail": '[{"a": 1}] x', "twice": '[{"a": 1}] [{"b": 2}]', "comma": '[{"a": 1},]',
        "gap": '[{"a": 1},,{"b": 2}]', "wrong": '[{"a": 1]]', "bare": '[{"a": 1}, nope]', "close": '[{"a": 1}}', "text": '"[1]"',
        "string": '[{"a": "}', "deep": "[" + "[" * 50 + "]" * 50 + ', {"z": {}}]', "brackets": '[{"a": "[[[{{{"}, {"b": "\\\\"}, {"c": "\\""}]',
        "large": json.dumps([{"a": "x}" * 200, "b": [{"c": "{"}] * 20}, {"d": 1}]),
    }
    for name, text in texts.items():
        (root / f"{name}.json").write_text(text)
    return str(root)


@pytest.mark.parametrize("split", [300, 1 << 27])
def test_cut_files_give_the_rows_of_whole_ones(spark, folder, split):
    def rows(limit):
        return sorted((r.file_path, r.block, r.pos, json.dumps(json.loads(r.raw_json.toJson()), sort_keys=True)) for r in scan_json(spark, folder, whole_file=limit).collect())

    def counters(limit):
        return sorted(tuple(r) for r in load_counters(spark, folder, whole_file=limit).collect())

    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = rows(1 << 40), counters(1 << 40)
    assert len(want[0]) > 20
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = rows(0), counters(0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[0] == want[0]
    # A large file that is no array is told by its first character; one without any text is not even that.
    odd = ("object", "text", "nothing", "blank")
    assert [c for c in got[1] if not any(f"/{o}.json" in c[0] for o in odd)] == [c for c in want[1] if not any(f"/{o}.json" in c[0] for o in odd)]
