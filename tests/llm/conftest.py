import pytest

pytest.importorskip("folia.llm")
