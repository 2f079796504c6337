"""Rules that do not hold on every screen hide nothing; wide columns line up."""

import pytest

from lakewarden.llm import render

HIDE = ".nav{display:none}"


@pytest.mark.parametrize(
    ("css", "hidden"),
    [
        (HIDE, True),
        ("@media print{" + HIDE + "}", False),
        ("@media print{p{margin:0}" + HIDE + "} b{color:red}", False),
        ("@media (max-width: 600px){a{b:c}" + HIDE + "}", False),
        ("@media screen and (max-width:600px){" + HIDE + "}", False),
        ("@media not screen{" + HIDE + "}", False),
        ("@media screen{" + HIDE + "}", True),
        ("@media only screen {" + HIDE + "}", True),
        ("@MEDIA print, all{" + HIDE + "}", True),
        ("@media print{@media screen{" + HIDE + "}}", False),
        ("@media screen{@media print{" + HIDE + "}}", False),
        ("@media print{p{margin:0}}" + HIDE, True),
        ("@import 'x.css';" + HIDE, True),
        ("@charset \"a{\"; p::before{content:'}'} " + HIDE, True),
        ("/* @media print{ */" + HIDE, True),
        ("/* " + HIDE + " */", False),
        (".nav{color:red;display:none;}", True),
        (".box{.nav{display:none}}", False),
        ("@supports (x:y){" + HIDE + "}", False),
        ("@layer base{" + HIDE + "}", True),
        ("@media print{" + HIDE, False),
        ("@keyframes nav{from{display:none}}", False),
    ],
)
def test_conditional_rules(css, hidden):
    assert ("menu" in render.rendered(f"<style>{css}</style><div class=nav>menu</div><p>text")) != hidden


def test_wide_columns_line_up():
    wide = "x" * 100
    lines = render.rendered(f"<table><tr><td>{wide}<td>one<tr><td>short<td>two<tr><td>alone<td></table>").split("\n")
    assert lines == [f"{wide}  one", f"{'short':100}  two", "alone"]
