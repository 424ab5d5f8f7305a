from fairlead.llm import common


def test_a_worker_keeps_what_one_operator_needs():
    made = []
    make = lambda: made.append(1) or object()
    first = common.held("one", "a", make)
    assert common.held("one", "a", make) is first and len(made) == 1
    assert common.held("one", "b", make) is not first and list(common.only("one")) == ["b"]
    assert common.only("two") == {} and list(common._kept) == ["two"]
    assert common.held("one", "b", make) and len(made) == 3


def test_a_map_body_starts_alone():
    common.held("one", "a", object)
    found = []
    assert list(common.lean("two", lambda batches: (found.append(dict(common._kept)) or x for x in batches))([1, 2])) == [1, 2]
    assert found[0] == {"two": {}}
