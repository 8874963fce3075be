"""Later mentions of a name, neutral titles, compact phone numbers, national ids."""

import re

from gatewise.llm import surrogates

TEXTS = [
    "Mr John Smith came. Later Smith left, John's hat and SMITH'S coat stayed; a smith worked.",
    "Prof. Dr. Ada O'Neil met Dr Jane Smith. O'Neil and Jane spoke",
    "Mrs Jane Brown",
    "call +905321234567 or +12125550123 or 5321234567 or 212 555 0123 or 0532 123 45 67",
    "id 10000000146 but order 10000000147",
    "Smith without a title",
    "Brown ate brown bread",
]


def test_entities_of_the_reference(spark):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = {r.doc_id: r for r in surrogates.surrogate_texts(table).collect()}
    out = [rows[i].text for i in range(len(TEXTS))]
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Later (\w+) left, (\w+)'s hat and (\w+)'S coat stayed; a smith worked\.", out[0])
    assert m and m[2] == m[3] != "Smith" and m[1] == m[4] != "John" and m[5] == m[2].upper() and rows[0].n_entities == 4
    n = re.fullmatch(r"Prof\. Dr\. (\w+) (\w+) met Dr (\w+) (\w+)\. (\w+) and (\w+) spoke", out[1])
    assert n and n[2] == n[5] and n[3] == n[6] and n[4] == m[2] and n[1] != "Ada" and rows[1].n_entities == 4
    assert out[2].split()[1] == n[3]  # Jane, whose gender another text states
    assert not any(x in out[3] for x in ("905321234567", "12125550123", "5321234567", "212 555 0123", "0532 123 45 67"))
    assert re.fullmatch(r"call \+\d{12} or \+\d{11} or \d{10} or \d{3} \d{3} \d{4} or \d{4} \d{3} \d{2} \d{2}", out[3]) and rows[3].n_entities == 5
    new, kept = re.fullmatch(r"id (\d{11}) but order (\d{11})", out[4]).groups()
    d = [int(c) for c in new]
    assert kept == "10000000147" and new != "10000000146" and d[10] == sum(d[:10]) % 10 and d[9] == (7 * sum(d[0:9:2]) - sum(d[1:8:2])) % 10
    assert out[5:] == TEXTS[5:]
