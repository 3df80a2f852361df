"""Rule sets as data. Operators take them as parameters; a profile bundles the
ones for one kind of documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from docloom.functions.temporal import NO_REGISTRY


@dataclass(frozen=True)
class TagRule:
    """Adds `tags`, pairs of (array field, tag), to a chunk whose normalised text
    holds one of any_of and, if given, one of and_any_of."""

    tags: tuple[tuple[str, str], ...]
    any_of: tuple[str, ...] = ()
    and_any_of: tuple[str, ...] = ()


@dataclass(frozen=True)
class TagGroup:
    """The rules are tested only on chunks that hold one of the gate phrases, or
    that are in one of the sections of one document."""

    gate: tuple[str, ...]
    rules: tuple[TagRule, ...]
    document: str | None = None
    sections: tuple[str, ...] = ()


TAG_FIELDS = ("policy_area", "action_tags", "student_status_tags", "procedure_tags", "evidence_groups", "risk_tags", "requirement_tags", "time_tags")


def _always(*tags: tuple[str, str]) -> TagRule:
    return TagRule(tags)


def _if(any_of: tuple[str, ...], *tags: tuple[str, str], also: tuple[str, ...] = ()) -> TagRule:
    return TagRule(tags, any_of, also)


PA, AC, ST, PR, EV, RK, RQ, TM = TAG_FIELDS

# Phrases and tags of the annotation rules, in rule order.
POLICY_TAGS = (
    TagGroup(
        ("dang ky mon hoc", "dang ky hoc phan", "khoi luong hoc tap", "dang ky muon", "dieu chinh khoi luong", "hoc vuot"),
        (
            _always((PA, "course_registration"), (AC, "register_course")),
            _if(("hoc vuot",), (AC, "study_ahead")),
            _if(("co van hoc tap",), (PR, "advisor_approval_required")),
            _if(("dang ky muon",), (TM, "late_registration_period")),
            _if(("thoi han", "ngoai thoi han"), (TM, "registration_period"), (RK, "missed_registration_deadline")),
        ),
    ),
    TagGroup(
        ("hoc lai", "cai thien diem", "diem thi cao nhat"),
        (
            _always((PA, "retake_and_grade_improvement"), (AC, "retake_course")),
            _if(("cai thien diem", "diem thi cao nhat"), (AC, "improve_grade"), (RQ, "passed_course_grade_improvement")),
            _if(("hoc lai",), (RQ, "failed_required_course"), also=("bat buoc", "khong dat")),
        ),
    ),
    TagGroup(
        ("canh bao ket qua hoc tap", "hoc luc kem", "buoc thoi hoc", "buoc nghi hoc tam thoi", "tu y bo hoc", "khong hoan thanh nghia vu hoc phi"),
        (
            _always((PA, "academic_standing"), (ST, "academic_warning"), (ST, "poor_academic_performance")),
            _if(("canh bao ket qua hoc tap", "hoc luc kem"), (AC, "academic_warning")),
            _if(("buoc nghi hoc tam thoi",), (AC, "temporary_suspension"), (RK, "forced_temporary_leave")),
            _if(("buoc thoi hoc",), (AC, "dismissal"), (RK, "forced_dropout")),
            _if(("tu y bo hoc",), (RK, "unauthorized_absence")),
            _if(("khong hoan thanh nghia vu hoc phi",), (RK, "tuition_debt")),
        ),
    ),
    TagGroup(
        ("nghi hoc tam thoi", "bao luu ket qua", "xin thoi hoc", "tam dung hoc tap"),
        (
            _always((PA, "leave_and_withdrawal")),
            _if(("nghi hoc tam thoi", "tam dung hoc tap"), (AC, "temporary_leave")),
            _if(("xin thoi hoc",), (AC, "withdrawal")),
            _if(("bao luu ket qua",), (AC, "reserve_study_results")),
            _always((PR, "application_required"), (PR, "decision_required")),
            _if(("giay xac nhan", "co quan y te", "benh vien"), (EV, "medical_certificate")),
            _if(("luc luong vu trang", "quan su", "dieu dong"), (EV, "military_order")),
        ),
    ),
    TagGroup(
        ("xet tot nghiep", "cong nhan tot nghiep", "dieu kien tot nghiep", "hoi dong xet tot nghiep"),
        (
            _always((PA, "graduation"), (AC, "graduation_audit")),
            _if(("bang tot nghiep", "cong nhan tot nghiep"), (AC, "degree_conferral")),
            _if(("diem trung binh chung tich luy", "2,00", "2.00"), (RQ, "minimum_gpa_required")),
            _if(("tich luy du so", "khoi luong", "so tin chi"), (RQ, "credit_completion_required")),
            _if(("chung chi giao duc quoc phong", "quoc phong"), (RQ, "national_defense_certificate_required")),
            _if(("giao duc the chat",), (RQ, "physical_education_completion_required")),
            _if(("don", "de nghi"), (PR, "graduation_application_required")),
        ),
        document="ou_fulltime_credit_training_regulation_2016",
        sections=("27", "28", "29"),
    ),
    TagGroup(
        ("mien mon hoc", "giam mon hoc", "xet mien", "xet mien giam", "chuyen diem", "bao luu ket qua", "tin chi duoc xet mien"),
        (
            _always((PA, "course_exemption")),
            _if(("mien mon hoc", "xet mien"), (AC, "request_course_exemption")),
            _if(("giam mon hoc", "xet mien giam"), (AC, "request_course_reduction")),
            _if(("chuyen diem",), (AC, "credit_transfer")),
            _if(("5,0", "5.0", "diem dat"), (RQ, "minimum_grade_required")),
            _if(("so tin chi", "tin chi tuong duong", "tin chi lon hon hoac bang"), (RQ, "credit_equivalence_required")),
            _if(("50%", "khong vuot qua 50"), (RQ, "credit_limit_50_percent")),
            _always((PR, "application_required")),
            _if(("bang diem",), (PR, "transcript_required"), (EV, "transcript")),
            _if(("de cuong mon hoc",), (PR, "syllabus_required"), (EV, "course_syllabus")),
            _if(("chung chi",), (EV, "certificate")),
        ),
    ),
    TagGroup(
        (
            "ngoai ngu khong chuyen", "tieng anh", "chuan dau vao", "chuan dau ra", "tieng anh du bi", "ky thi danh gia nang luc", "chung chi tieng anh",
            "ielts", "toeic", "toefl", "aptis", "cambridge",
        ),
        (
            _always((PA, "foreign_language_requirement")),
            _if(("kiem tra trinh do", "xep lop", "dau vao"), (AC, "english_placement_test")),
            _if(("ky thi danh gia nang luc", "thi danh gia"), (AC, "english_exit_exam")),
            _if(("xet mien", "mien tieng anh"), (AC, "request_english_exemption")),
            _if(("chuan dau vao", "dau vao"), (RQ, "english_entry_requirement")),
            _if(("chuan dau ra", "dau ra"), (RQ, "english_exit_requirement")),
            _if(("chung chi", "ielts", "toeic", "toefl", "aptis", "cambridge"), (RQ, "certificate_requirement"), (EV, "language_certificate")),
            _if(("ke hoach dao tao", "lan/nam", "3 lan"), (TM, "annual_training_plan"), (TM, "exam_schedule")),
        ),
    ),
    TagGroup(
        (
            "ngoai ngu hai", "tieng phap", "tieng nhat", "tieng han", "tieng trung", "tieng nga", "tieng duc", "tieng tay ban nha",
            "delf", "jlpt", "nat-test", "topik", "hsk", "tocfl", "trki", "goethe",
        ),
        (
            _always(
                (PA, "second_foreign_language_requirement"), (AC, "request_second_language_exemption"), (RQ, "second_language_certificate_requirement"), (EV, "language_certificate"),
            ),
        ),
    ),
    TagGroup(
        (
            "thi cuoi ky", "ky thi", "phuc tra", "khieu nai diem", "thang diem", "diem trung binh chung", "diem trung binh chung tich luy",
            "bang diem", "vang thi", "diem 0",
        ),
        (
            _always((PA, "assessment_and_grading")),
            _if(("thi cuoi ky", "ky thi cuoi"), (AC, "take_final_exam")),
            _if(("phuc tra", "khieu nai diem"), (AC, "appeal_grade"), (PR, "appeal_application_required")),
            _if(("diem trung binh chung",), (AC, "calculate_gpa")),
            _if(("diem 0", "vang thi"), (RK, "zero_score"), (RK, "exam_absence")),
        ),
    ),
)


@dataclass(frozen=True)
class Issue:
    issue_type: str
    policy_area: str | None
    label: str
    keywords: tuple[str, ...]
    query_default: str
    #: (keywords, query): the first whose keyword is in the question.
    query_when: tuple[tuple[tuple[str, ...], str], ...] = ()
    answer: str = ""
    #: (keywords, answer): the first whose keyword is in the issue's query.
    answer_when: tuple[tuple[tuple[str, ...], str], ...] = ()
    #: What to ask the user back.
    missing: tuple[str, ...] = ()


CERTIFICATES = ("ielts", "toeic", "toefl", "aptis", "cambridge", "chung chi")

# Types, keywords and queries of the issues.
POLICY_ISSUES = (
    Issue("graduation", "graduation", "Tốt nghiệp", ("tot nghiep", "xet tot nghiep", "bang tot nghiep"), "dieu kien xet tot nghiep", answer="Xem Điều 27 về điều kiện xét tốt nghiệp."),
    Issue(
        "course_exemption", "course_exemption", "Miễn giảm môn học", ("mien mon", "giam mon", "bang diem", "da hoc truong khac", "chuyen diem", "ho so mien"),
        "dieu kien xet mien giam mon hoc", ((("ho so",), "ho so xin mien giam mon hoc"),), "Xem Điều 4 về điều kiện miễn, giảm môn học.", ((("ho so",), "Xem Điều 5 về hồ sơ miễn, giảm môn học."),),
    ),
    Issue(
        "foreign_language_requirement", "foreign_language_requirement", "Ngoại ngữ", ("tieng anh", "ielts", "toeic", "toefl", "aptis", "cambridge"),
        "chuan dau ra tieng anh ngoai ngu khong chuyen", ((CERTIFICATES, "xet mien tieng anh chung chi ielts toeic toefl aptis cambridge"),), "Xem Điều 9 và Phụ lục I; IELTS và các chứng chỉ khác cần được kiểm tra.",
    ),
    Issue("course_registration", "course_registration", "Đăng ký môn học", ("dang ky mon", "hoc vuot", "khoi luong hoc tap"), "dang ky mon hoc hoc vuot khoi luong hoc tap", answer="Xem quy định về đăng ký môn học và khối lượng học tập."),
    Issue("retake_and_grade_improvement", "retake_and_grade_improvement", "Học lại, cải thiện điểm", ("hoc lai", "cai thien diem"), "dang ky hoc lai cai thien diem mon hoc", answer="Xem quy định về học lại và cải thiện điểm."),
    Issue("academic_standing", "academic_standing", "Cảnh báo học tập", ("canh bao", "hoc luc kem", "buoc thoi hoc"), "canh bao ket qua hoc tap buoc thoi hoc", answer="Xem quy định về cảnh báo kết quả học tập và buộc thôi học."),
    Issue("generic", None, "Quy định liên quan", (), "", answer="Xem các quy định sau."),
)


@dataclass(frozen=True)
class When:
    """A conjunction over a candidate: each given part must hold. section: the
    section number is one of these. title, query: the normalised section title,
    or the issue's query, holds one of these. area: the issue's area is among
    the chunk's areas (True), is not (False). not_section, no_title: none."""

    section: tuple[str, ...] = ()
    title: tuple[str, ...] = ()
    query: tuple[str, ...] = ()
    no_query: tuple[str, ...] = ()
    area: bool | None = None
    not_section: tuple[str, ...] = ()
    no_title: tuple[str, ...] = ()


@dataclass(frozen=True)
class Selection:
    """For one issue type: priorities, the first that holds; bonuses, the sum of
    those that hold; keep, [(least priority, condition)] of which one must hold
    for a source to survive pruning. not_alone: [(priority, condition)] of the
    sources that do not survive as an issue's only one."""

    priorities: tuple[tuple[When, int], ...]
    bonuses: tuple[tuple[When, float], ...]
    keep: tuple[tuple[int, When], ...]
    not_alone: tuple[tuple[int, When], ...] = ()


def _titled(*words: str) -> Selection:
    return Selection(((When(area=False), -1), (When(title=words), 2), (When(), 1)), ((When(area=True), 10.0), (When(area=False), -30.0), (When(title=words), 30.0)), ((2, When()),))


DOSSIER = ("ho so", "nop", "giay to", "don", "minh chung", "thu tuc")

# Priorities, bonuses and pruning of sources by issue type.
POLICY_SELECTION = {
    "graduation": Selection(
        (
            (When(area=False), -1), (When(section=("27",)), 3), (When(title=("dieu kien xet tot nghiep", "cong nhan tot nghiep")), 3),
            (When(section=("28", "29")), 2), (When(title=("bang tot nghiep", "van bang tot nghiep")), 2), (When(), 1),
        ),
        (
            (When(area=True), 10.0), (When(section=("27",)), 50.0), (When(title=("dieu kien xet tot nghiep", "cong nhan tot nghiep")), 50.0), (When(section=("28", "29")), 20.0),
            (When(title=("bang tot nghiep", "van bang tot nghiep")), 20.0), (When(area=False, not_section=("27", "28", "29")), -30.0),
        ),
        ((2, When()),),
    ),
    "course_exemption": Selection(
        (
            (When(area=False), -1), (When(query=("ho so",), section=("5",), title=("ho so",)), 3), (When(query=("ho so",), section=("4",)), 2),
            (When(query=("ho so",)), 1), (When(section=("4",), title=("dieu kien",)), 3), (When(section=("5",)), 2), (When(), 1),
        ),
        (
            (When(area=True), 10.0), (When(query=("ho so",), section=("5",), title=("ho so",)), 50.0), (When(query=("ho so",), section=("4",)), 20.0),
            (When(no_query=("ho so",), section=("4",), title=("dieu kien",)), 50.0), (When(no_query=("ho so",), section=("5",)), 20.0), (When(area=False, not_section=("4", "5")), -30.0),
        ),
        ((2, When(query=("ho so",))), (3, When()), (2, When(section=("5",), query=DOSSIER))),
        ((2, When(no_query=("ho so",))),),
    ),
    "foreign_language_requirement": Selection(
        (
            (When(area=False), -1), (When(query=CERTIFICATES, title=("phu luc i", "xet mien ngoai ngu")), 3), (When(query=CERTIFICATES, section=("9",)), 3), (When(query=CERTIFICATES), 1),
            (When(section=("5", "8", "9")), 2), (When(title=("chuan dau ra", "ky thi", "xet mien")), 2), (When(), 1),
        ),
        (
            (When(area=True), 10.0), (When(query=CERTIFICATES, title=("phu luc i",)), 50.0), (When(query=CERTIFICATES, section=("9",)), 50.0),
            (When(query=CERTIFICATES, title=("xet mien ngoai ngu",), not_section=("9",)), 50.0), (When(no_query=CERTIFICATES, section=("5", "8", "9")), 30.0),
            (When(no_query=CERTIFICATES, title=("chuan dau ra", "ky thi", "xet mien"), not_section=("5", "8", "9")), 30.0),
            (When(area=False, not_section=("5", "8", "9"), no_title=("phu luc i",)), -30.0),
        ),
        ((3, When(query=CERTIFICATES)), (2, When(no_query=CERTIFICATES))),
    ),
    "course_registration": _titled("dang ky", "khoi luong hoc tap", "hoc vuot"),
    "retake_and_grade_improvement": _titled("hoc lai", "cai thien diem"),
    "academic_standing": _titled("canh bao", "buoc thoi hoc"),
}


@dataclass(frozen=True)
class Profile:
    tags: tuple[TagGroup, ...] = POLICY_TAGS
    issues: tuple[Issue, ...] = POLICY_ISSUES
    selection: dict[str, Selection] = field(default_factory=lambda: POLICY_SELECTION)
    #: Closing lines: when a current notice is missing, and otherwise.
    notice: str = "Chưa có thông báo của học kỳ hiện tại; chưa thể kết luận về thời hạn."
    disclaimer: str = "Hãy đối chiếu trường hợp của mình với các căn cứ trên."
    current_term: tuple[str, ...] = NO_REGISTRY


POLICY = Profile()


def profile_from_config(config: dict) -> Profile:
    """The profile of a domain configuration, with defaults for what it lacks."""
    return Profile(
        issues=from_config(config), notice=config.get("current_semester_missing_notice_message", POLICY.notice), disclaimer=config.get("fallback_scope_disclaimer", POLICY.disclaimer),
        current_term=tuple(config.get("current_semester_keywords", POLICY.current_term)),
    )



def from_config(config: dict) -> tuple[Issue, ...]:
    """Issues of a domain configuration (the parsed JSON)."""
    found = []
    for d in config.get("issue_definitions", []):
        found.append(
            Issue(
                d["issue_type"], d.get("policy_area"), d.get("label", ""), tuple(d.get("keywords", [])), d.get("query_default", ""),
                tuple((tuple(w.get("condition_keywords", [])), w["query"]) for w in d.get("query_when", [])), d.get("answer_template", ""),
                tuple((tuple(w.get("condition_keywords", [])), w.get("answer_template", "")) for w in d.get("answer_template_override", [])),
                tuple(d.get("missing_information_questions", [])),
            )
        )
    return tuple(found)
