import pytest


@pytest.fixture(scope="session")
def words():
    """A pool of words for made-up texts."""
    return [a + b for a in ("ka", "lo", "mi", "ru", "te", "va", "zo", "ne") for b in ("bra", "dil", "fon", "gus", "hem", "jat", "kel")]
