"""Secrets of any length and shape."""

import re

from gazeframe.llm import private


def test_whole_secrets_are_masked(spark):
    long, dotted = "aB3" * 66 + "xy", "eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSM=="
    old = [f"token={long} end", f"token: {dotted}. Then", f'api_key     =      "{dotted}"', "token=x.y12345@mail.example.com"]
    df = spark.createDataFrame(list(enumerate(old)), "i int, text string")
    new = [r.text for r in private.protect(df, "k").orderBy("i").collect()]
    for a, b in zip(old, new):
        assert len(a) == len(b) and a != b
    assert long[-20:] not in new[0] and new[0].startswith("token=") and new[0].endswith(" end")
    assert not any(part in x for x in new[1:3] for part in ("eyJhbGciOi", "eyJzdWIiOiIx", "SflKxwRJSM"))
    one = re.search(r"token: (\S+)\. Then", new[1])[1]
    assert new[2] == f'api_key     =      "{one}"'
    assert "x.y12345" not in new[3] and new[3].endswith(".com")


def changed(spark, old, key="k"):
    df = spark.createDataFrame(list(enumerate(old)), "i int, text string")
    return [r.text for r in private.protect(df, key).orderBy("i").collect()]


def test_values_before_other_numbers(spark):
    card, account = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    phones = "555-123-4567 555-123-4568"
    old = [card, f"{card} 12/27", f"{card} 123", f"{card} 555-123-4567", account, f"{account} I paid", f"{account} 12 May",
           f"{account} {card}", phones, "555-123-4567", "+1 555 123 4567 12 times", "+1 555 123 4567", "1-800-555-1234",
           "800-555-1234", "1234 5678 9012 3456 78"]
    new = changed(spark, old)
    assert new[0] != card and new[1] == new[0] + " 12/27" and new[2] == new[0] + " 123"
    assert new[4] != account and new[5] == new[4] + " I paid" and new[6] == new[4] + " 12 May" and new[7] == f"{new[4]} {new[0]}"
    assert new[9] != old[9] and new[3] == f"{new[0]} {new[9]}"
    assert new[8].split()[0] == new[9] and new[8].split()[1] not in (phones.split()[1], new[9])
    assert new[10] == new[11] + " 12 times" and new[11] != old[11]
    assert new[12] == "1-" + new[13] and new[13] != old[13]
    assert new[14] == old[14]


def test_short_secrets_and_signs(spark):
    old = ["password=P@ssw0rd123!", "password: hunter2", "Password: changed yesterday", "the token: an idea", 'secret="a1!b2#c3$" x']
    new = changed(spark, old)
    assert "P@ss" not in new[0] and "w0rd" not in new[0] and "123" not in new[0]
    assert "hunter2" not in new[1] and new[1].startswith("password: ")
    assert new[2:4] == old[2:4]
    assert new[4] != old[4] and new[4].startswith('secret="') and new[4].endswith('$" x')
