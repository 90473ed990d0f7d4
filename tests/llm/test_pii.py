"""Personal information: lists of any length, spelled numbers, brackets, names by their verbs, repeated names."""

import pytest

from docweave.llm import pii

FAR = "a line of plain words about nothing, " * 8
TWELVE = ["Karl Lund", "Mara Ellison", "Tove Lindqvist", "Aron Belka", "Nils Okafor", "Ann Lee", "Karl Lundberg", "Joss Nyborg", "Ilka Velk", "Fenna Pasko", "Oswin Drummel", "Calla Ferrow"]
KO = ["강다결", "황슬울", "박도현", "김하린"] * 24

CASES = [
    (f"Attendees: {', '.join(TWELVE)}", TWELVE),
    (f"{FAR}\n참석: {', '.join(KO)}. 안건은 없다.\n{FAR}", KO),
    (f"Attendees:\n- {TWELVE[0]}\n- {TWELVE[1]}\n2) {TWELVE[2]}\nThe end", TWELVE[:3]),
    ("참석자:\n- 강다결\n- 황슬울 팀장\n끝", ["강다결", "황슬울"]),
    ("call two one two five five five one two three four now", ["two one two five five five one two three four"]),
    ("TWO ONE TWO FIVE FIVE FIVE ONE TWO THREE FOUR", ["TWO ONE TWO FIVE FIVE FIVE ONE TWO THREE FOUR"]),
    ("연락처는 공일공일이삼사오육칠팔로 주세요", ["공일공일이삼사오육칠팔"]),
    ("공이 일이삼사 오육칠팔", ["공이 일이삼사 오육칠팔"]),
    ("zero zero zero eight two four five nine seven", ["zero zero zero eight two four five nine seven"]),
    ("담당자 홍나새 주임 (010 1975 8994) 앞으로", ["홍나새", "010 1975 8994"]),
    ("담당자 홍나새 주임 ((031) 053-8874) 앞으로", ["홍나새", "(031) 053-8874"]),
    ("대표번호 051) 118-8513 또는 (031) 053-8874", ["051) 118-8513", "(031) 053-8874"]),
    ("Yesterday Joss Nyborg repaired the coil; Joss Nyborg's report follows.", ["Joss Nyborg", "Joss Nyborg"]),
    ("박도현은 떠났다. 나중에 박도현이 왔다.", ["박도현", "박도현"]),
    ("남궁민수 팀장이 확인, 남궁민수는 전화", ["남궁민수", "남궁민수"]),
    ("The Radio Navigation required work. The Power Unit failed. 정류기는 도착했다. 전원반은 정비팀이 승인했다.", []),
    (f"see {'x' * 300}@site.example now", ["x" * 300 + "@site.example"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_items(text, want):
    assert [text[i:j] for _, i, j in pii.items(text)] == want


def test_redaction_leaves_no_torn_name():
    text = f"Attendees: {', '.join(TWELVE)}"
    assert pii.redacted(text, pii.items(text)) == "Attendees: " + ", ".join(["[PERSON_NAME]"] * 12)
