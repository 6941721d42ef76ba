import pytest

from sitelode.llm import personal


@pytest.mark.parametrize("text", ["info [arroba] tienda.example", "info{at}x.example", "info (chez) x.test", "info <at> x.test", "info (ät) x.test"])
def test_every_notation_passes_the_gate(text):
    assert [(k, text[a:b]) for k, a, b, _, _ in personal.candidates(text, personal.Gazetteer([]))] == [("email", text)]
