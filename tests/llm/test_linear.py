"""Time of the lexer on long texts, and what single passes must still find."""

import time

import pytest

from tickloom.llm import secrets

K = "9fK2mmQ8zL1p"
SIZE = 1_000_000
LONG = {
    "list of keys": lambda n: "a:\n" + "- b:\n" * (n // 5),
    "list of items": lambda n: "pwd:\n" + f"- {K}\n" * (n // 15),
    "named tags": lambda n: "<a" + ' name="db.pwd"' * (n // 14) + ">",
    "appends": lambda n: "auth = ''\n" + f"auth = auth + '{K}'\n" * (n // 29),
    "added in place": lambda n: "auth = ''\n" + f"auth += '{K}'\n" * (n // 22),
    "forward chain": lambda n: "".join(f"auth{i} = auth{i + 1} + '{K}'\n" for i in range(n // 40)),
    "brackets": lambda n: "[" * n,
    "closed brackets": lambda n: "a" + "]" * n + "=1",
    "bracketed signs": lambda n: "a]=" * (n // 3),
    "staircase": lambda n: "".join(" " * i + "pwd:\n" for i in range(int((2 * n) ** 0.5))),
    "quotes": lambda n: "x = \"" * (n // 5),
    "elements": lambda n: "<pwd>" * (n // 5),
    "blocks": lambda n: "pwd: |\n" * (n // 7),
}


@pytest.mark.parametrize("kind", LONG)
def test_a_megabyte_takes_seconds(kind):
    text = LONG[kind](SIZE)
    began = time.process_time()
    spans = secrets.all_spans(text)
    assert time.process_time() - began < 20
    if kind == "appends":
        assert len(spans) == SIZE // 29
    if kind == "list of items":
        assert len(spans) == SIZE // 15


YAML = {
    f"pwd:\n- {K}\n- {K}x": [K, f"{K}x"],
    f"a:\n  pwd:\n    - {K}\n  b:\n    - {K}y": [K],
    f"users:\n- pwd:\n  - {K}\n- name:\n  - {K}z": [K],
    f"pwd:\n\n  - {K}\n": [K],
    f"secrets_file:\n  inner: |\n    {K}\nnext: |\n  {K}q": [],
    f"data: |\n  privateKey: |\n    {K}\n  other: x": [K],
    f"pwd:\nname:\n  - {K}": [],
    f'<a name="db.pwd" name="x" value="{K}"/>': [K],
    f'<a name="x"/><b value="{K}"/>': [],
    f'pwd = os.environ.get("DB_PWD_NAME1", "{K}")': [K],
    'pwd = os.environ["DB_PWD_NAME1"]': [],
    'pwd = vault.read("secret/data/db1")': [],
    'pwd = get_secret("prod/db/pwd1")': [],
    f'pwd = decode("{K}")': [K],
    f'a = b + "{K}"\nb = a\nauth = a': [K],
    f'x = "{K}"\ny = x + x\nauth = y + x': [K],
}


@pytest.mark.parametrize("text", YAML)
def test_single_passes_find(text):
    found = [text[a:b] for kind, _, _, a, b in secrets.all_spans(text)]
    want = YAML[text]
    if "secrets_file" in text:
        # A file's name is sensitive by a word of it; its inner block is not.
        assert f"{K}q" not in found
    else:
        assert found == want
