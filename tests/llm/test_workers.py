from sys import getsizeof

from lumbre.llm import workers as W


def test_memory_is_bounded_by_bytes():
    memory = W.Memory(lambda x: x * 3, limit=20_000)
    assert [memory[str(i)] for i in range(2000)] == [str(i) * 3 for i in range(2000)]
    assert sum(getsizeof(k) + getsizeof(v) for k, v in [*memory.items(), *memory.old.items()]) <= 20_000
    assert len(memory) and len(memory.old)


def test_memory_counts_the_parts_of_tuples_and_leaves_out_long_keys():
    memory = W.Memory(lambda x: (x, "y" * 5000), limit=20_000, longest=3)
    for i in range(100):
        assert memory[str(i)] == (str(i), "y" * 5000)
    assert len(memory) + len(memory.old) <= 4
    assert memory["long"] == ("long", "y" * 5000) and "long" not in memory


def test_a_worker_holds_one_tool():
    made = []

    def tool(*given):
        made.append(given)
        return [given]

    first = W.held(tool, 1)
    assert W.held(tool, 1) is first and made == [(1,)]
    W.held(tool, 2)
    assert len(W._held) == 1 and W.held(tool, 1) == [(1,)] and len(made) == 3
