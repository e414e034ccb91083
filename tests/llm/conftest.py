import pytest

pytest.importorskip("loomtext.llm")
