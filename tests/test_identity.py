import random

import pytest

from curbledger.operators import identity


def brute(rows):
    """Owner and reach by the definition: all links, their closure, ranks."""
    phones = {}
    for phone, plate in rows:
        phones.setdefault(phone, set()).add(plate)
    after = {}
    for plates in phones.values():
        for a in plates:
            after.setdefault(a, set()).update(b for b in plates if a < b)
    plates = sorted(after)
    reach = {}
    for a in reversed(plates):
        reach[a] = set(after[a])
        for b in after[a]:
            reach[a] |= reach[b]
    ranks = {a: (len(reach[a]), a) for a in plates if reach[a]}
    owner = {}
    for a, rank in ranks.items():
        for b in {a} | reach[a]:
            owner[b] = max(owner.get(b, (0, "")), rank)
    minors = set().union(*reach.values()) if reach else set()
    roots = {a: n for a, (n, _) in ranks.items() if a not in minors}
    return {b: a for b, (_, a) in owner.items()}, roots


def random_rows(seed):
    rng = random.Random(seed)
    plates, phones = 10 + rng.randrange(40), 6 + rng.randrange(30)
    rows = {(f"t{rng.randrange(phones):02d}", f"p{rng.randrange(plates):02d}") for _ in range(rng.randrange(20, 90))}
    if seed % 2:  # a hot phone
        rows |= {("t00", f"p{i:02d}") for i in range(plates) if rng.random() < 0.6}
    if seed % 3 == 0:  # a hot plate
        rows |= {(f"t{i:02d}", "p05") for i in range(phones) if rng.random() < 0.6}
    return sorted(rows)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("hot_size", [2, 1000])
def test_owners_by_definition(spark, seed, hot_size):
    rows = random_rows(seed)
    owners, reach = identity.link_owners(spark.createDataFrame(rows, "phone string, plate string"), hot_size)
    expected_owner, expected_reach = brute(rows)
    assert {r.plate: r.owner for r in owners.collect()} == expected_owner
    assert {r.root: r.reach for r in reach.collect()} == expected_reach


def test_link_over_a_shared_minor(spark):
    """A-C and B-C share phones: C goes to the higher rank of A and B, the other stays apart."""
    rows = [("1", "A"), ("1", "C"), ("2", "B"), ("2", "C")]
    owners, _ = identity.link_owners(spark.createDataFrame(rows, "phone string, plate string"))
    assert {r.plate: r.owner for r in owners.collect()} == {"A": "A", "B": "B", "C": "B"}


def test_hot_phone_makes_few_rows(spark):
    """A phone with a third of all rows and a root behind each of its plates stays linear."""
    n = 600
    rows = [("hot", f"m{i:04d}") for i in range(n)]
    rows += [(f"s{i}", f"a{i:04d}") for i in range(n)] + [(f"s{i}", f"m{i:04d}") for i in range(n)]
    frame = spark.createDataFrame(rows, "phone string, plate string")
    phones = identity._split(frame, 100)
    hot_plates = phones.hot.select("plate").distinct()
    pairs, stops = identity._expand(phones.roots, phones.cold, hot_plates)
    assert pairs.count() + stops.count() <= 2 * n
    owners, reach = identity.link_owners(frame, 100)
    expected_owner, expected_reach = brute(rows)
    assert {r.plate: r.owner for r in owners.collect()} == expected_owner
    assert {r.root: r.reach for r in reach.collect()} == expected_reach


def test_offices_do_not_link_and_logins(spark):
    contacts = spark.createDataFrame(
        [("A", "x", "11"), ("B", "y", "11"), ("B", "y", "05"), ("C", "管理處", "11"), ("D", "", ""), ("E", "e", "77")],
        "cd_license string, c_name string, c_num string",
    )
    owners, _ = identity.link_owners(identity.link_rows(contacts))
    out = identity.login_names(identity.customer_groups(contacts, owners)).collect()
    login = {r.cd_license: r.login_name for r in out}
    assert login == {"A": "05", "B": "05", "C": "CU000001", "D": "CU000002", "E": "77"}
    assert {r.cd_license: r.owner for r in out} == {"A": "A", "B": "A", "C": "C", "D": None, "E": "E"}
