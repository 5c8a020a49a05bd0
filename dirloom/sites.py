"""The nine sites, as rows of the site tables."""

from __future__ import annotations

from .sources import SiteSpec

# What each site calls its departments in URLs.
EWU = {
    "computer-science-engineering": "Computer Science and Engineering",
    "electrical-electronic-engineering": "Electrical and Electronic Engineering",
    "electronics-communications-engineering": "Electronics and Communications Engineering",
    "civil-engineering": "Civil Engineering",
    "genetic-engineering-biotechnology": "Genetic Engineering and Biotechnology",
    "mathematical-physical-science": "Mathematical and Physical Sciences",
    "pharmacy-department": "Pharmacy",
    "business-administration": "Business Administration",
    "economics-department": "Economics",
    "masters-of-business-administration": "MBA and EMBA Programs",
    "english-department": "English",
    "law-department": "Law",
    "sociology-department": "Sociology",
    "social-relations-department": "Social Relations",
    "information-studies-library-management": "Information Studies and Library Management",
}

SEU = {
    "cse": "Computer Science and Engineering",
    "eee": "Electrical and Electronic Engineering",
    "textile": "Textile Engineering",
    "pharmacy": "Pharmacy",
    "architecture": "Architecture",
    "bba": "Business Administration",
    "mba": "Business Administration",
    "economics": "Economics",
    "english": "English",
    "law": "Law",
    "bangla": "Bangla",
    "islamic-studies": "Islamic Studies",
    "islamic_studies": "Islamic Studies",
    "ict": "Information and Communication Technology",
    "ice": "Information and Communication Engineering",
    "ete": "Information and Communication Engineering",
    "ged": "General Education",
    "math": "Mathematics",
}

ULAB = {
    "cse": "Computer Science and Engineering",
    "eee": "Electrical and Electronic Engineering",
    "bcs-eee": "Electrical and Electronic Engineering",
    "ete": "Electronics and Telecommunication Engineering",
    "ba": "Business Administration",
    "bba": "Business Administration",
    "mba": "Business Administration",
    "usb": "Business Administration",
    "deh": "English and Humanities",
    "ged": "General Education",
    "msj": "Media Studies and Journalism",
    "bll": "Bangla Language and Literature",
}

BUFT = {
    "department-of-fashion-design-and-technology": "Fashion Design and Technology",
    "department-of-arts-in-fashion-studies": "Fashion Studies",
    "department-of-textile-engineering-and-management": "Textile Engineering and Management",
    "department-of-apparel-merchandising-and-management": "Apparel Merchandising and Management",
    "department-of-knitwear-engineering": "Knitwear Manufacturing and Technology",
    "department-of-industrial-engineering": "Industrial Engineering",
    "department-of-computer-science-and-engineering": "Computer Science and Engineering",
    "department-of-business-administration": "Business Administration",
    "department-of-english": "English",
    "department-of-sciences": "Sciences",
    "department-of-environmental-science": "Environmental Science",
    "buft-institute-of-fashion-and-technology": "BUFT Institute of Fashion and Technology",
    "department-of-apparel-manufacturing-engineering": "Apparel Manufacturing Engineering",
    "department-of-economics": "Economics",
    "department-of-law": "Law",
}

CUB = {
    "cse": "Computer Science and Engineering",
    "eee": "Electrical and Electronic Engineering",
    "business": "Business Administration",
    "bba": "Business Administration",
    "law": "Law",
    "english": "English",
    "ged": "General Education",
    "pbh": "Public Health",
    "mcj": "Media, Communication and Journalism",
}

UAP = {
    "cse": "Computer Science and Engineering",
    "ce": "Civil Engineering",
    "eee": "Electrical and Electronic Engineering",
    "pharmacy": "Pharmacy",
    "lhr": "Law and Human Rights",
    "law": "Law and Human Rights",
    "arch": "Architecture",
    "architecture": "Architecture",
    "bba": "Business Administration",
    "business": "Business Administration",
    "english": "English",
    "bsh": "Basic Sciences and Humanities",
}

EUB = {
    "ipe": "Industrial and Production Engineering",
    "cse": "Computer Science and Engineering",
    "eee": "Electrical and Electronic Engineering",
    "civil": "Civil Engineering",
    "ce": "Civil Engineering",
    "textile": "Textile Engineering",
    "te": "Textile Engineering",
    "me": "Mechanical Engineering",
    "mechanical": "Mechanical Engineering",
    "bba": "Business Administration",
    "business-administration": "Business Administration",
    "law": "Law",
    "english": "English",
    "thm": "Tourism and Hospitality Management",
    "economics": "Economics",
    "mathematics": "Mathematics",
    "math": "Mathematics",
    "mth": "Mathematics",
}

BUBT = {
    "department-of-computer-science-engineering": "Computer Science and Engineering",
    "department-of-electrical-electronic-engineering": "Electrical and Electronic Engineering",
    "department-of-management": "Management",
    "department-of-mathematics-statistics": "Mathematics and Statistics",
    "department-of-accounting": "Accounting",
    "department-of-finance": "Finance",
    "department-of-marketing": "Marketing",
    "department-of-textile-engineering": "Textile Engineering",
    "department-of-civil-engineering": "Civil Engineering",
    "department-of-english": "English",
    "department-of-economics": "Economics",
    "department-of-law-justice": "Law and Justice",
    "department-of-business-administration": "Business Administration",
    "cse": "Computer Science and Engineering",
    "eee": "Electrical and Electronic Engineering",
    "management": "Management",
    "accounting": "Accounting",
    "finance": "Finance",
    "marketing": "Marketing",
    "textile": "Textile Engineering",
    "civil": "Civil Engineering",
    "english": "English",
    "economics": "Economics",
    "law": "Law and Justice",
}

PRIME = {
    "department-of-english": "English",
    "department-of-electrical-and-electronic-engineering-eee": "Electrical and Electronic Engineering",
    "department-of-computer-science-engineering": "Computer Science and Engineering",
    "department-of-civil-engineering": "Civil Engineering",
    "department-of-civil-engineering-ce": "Civil Engineering",
    "department-of-law": "Law",
    "department-of-business-administration": "Business Administration",
    "department-of-education": "Education",
    "department-of-bangla": "Bangla",
    "department-of-electronics-and-telecommunication-engineering-ete": "Electronics and Telecommunication Engineering",
    "department-of-fashion-design-and-apparel-engineering": "Fashion Design and Apparel Engineering",
}

# Parts of the sites' list addresses.
EWU_SCHOOLS = {
    "fse": list(EWU)[:7],
    "fbe": ["business-administration", "economics-department", "masters-of-business-administration"],
    "flass": ["english-department", "law-department", "sociology-department", "social-relations-department", "information-studies-library-management"],
}
SEU_SLUGS = [
    "cse", "english", "law", "textile", "pharmacy", "eee", "bba", "economics", "architecture",
    "bangla", "islamic-studies", "ict", "ice", "ete", "mba", "math", "ged",
]
CUB_SUBSITES = ["cse", "eee", "business", "law", "english", "ged", "pbh", "mcj"]
UAP_SUBSITES = ["cse", "ce", "eee", "pharmacy", "lhr", "arch", "bba", "english"]

SITES = [
    SiteSpec(
        key="ewu",
        short_name="EWU",
        name="East West University",
        homepage="https://www.ewubd.edu",
        domains=["ewubd.edu"],
        starts=["https://www.ewubd.edu/", "https://fse.ewubd.edu/", "https://fbe.ewubd.edu/", "https://flass.ewubd.edu/"],
        seeds=[f"https://{school}.ewubd.edu/{slug}/faculty-members" for school, slugs in EWU_SCHOOLS.items() for slug in slugs],
        listing=[r"ewubd\.edu/[\w-]+/faculty-members/?(?:\?.*)?$"],
        follow=[r"^https?://(?:fse|fbe|flass)\.ewubd\.edu/[\w-]+/?$"],
        profile=[r"ewubd\.edu/(?:[\w-]+/)?faculty-view/[^/?#]+"],
        exclude=[r"/news-details/", r"/achievement", r"/on-going-research", r"/category-courses", r"/events?[/-]"],
        departments=EWU,
    ),
    SiteSpec(
        key="seu",
        short_name="SEU",
        name="Southeast University",
        homepage="https://seu.edu.bd",
        domains=["seu.edu.bd"],
        starts=["https://seu.edu.bd/"],
        seeds=[*(f"https://seu.edu.bd/{slug}-faculties-staff" for slug in SEU_SLUGS), "https://seu.edu.bd/dept/islamic_studies.php?id=faculty"],
        listing=[r"seu\.edu\.bd/[\w-]+-faculties-staff/?$", r"seu\.edu\.bd/dept/\w+\.php\?id=faculty$"],
        follow=[
            r"seu\.edu\.bd/(?:bsc|ba|bba|llb|bpharm|b-pharm|bss|ma|mba|msc|llm|mpharm|barch)[-_]in[-_][\w-]+/?$",
            r"seu\.edu\.bd/dept/\w+\.php$",
            r"seu\.edu\.bd/(?:school|department)s?[-_/][\w-]*$",
        ],
        profile=[r"seu\.edu\.bd/(?:faculty|profile|faculty-profile)/[\w.-]+/?$"],
        exclude=[r"id=research", r"id=chairman_message", r"/notice", r"/news"],
        departments=SEU,
    ),
    SiteSpec(
        key="ulab",
        short_name="ULAB",
        name="University of Liberal Arts Bangladesh",
        homepage="https://ulab.edu.bd",
        domains=["ulab.edu.bd"],
        starts=["https://ulab.edu.bd/", "https://usb.ulab.edu.bd/", "https://eee.ulab.edu.bd/", "https://ged.ulab.edu.bd/", "https://deh.ulab.edu.bd/"],
        seeds=[
            "https://ulab.edu.bd/faculty-members-0",
            "https://ulab.edu.bd/people/cse-faculty",
            "https://ulab.edu.bd/people/eee-faculty",
            "https://ulab.edu.bd/people/ba-faculty",
            "https://eee.ulab.edu.bd/people/eee-faculty",
            "https://ete.ulab.edu.bd/people/ete-faculty",
            "https://ged.ulab.edu.bd/people/ged-faculty",
            "https://deh.ulab.edu.bd/people/deh-faculty",
            "https://ulab.edu.bd/people/msj-faculty",
            "https://ulab.edu.bd/people/bll-faculty",
            "https://usb.ulab.edu.bd/faculty/",
        ],
        listing=[
            r"/people/[\w-]*facult(?:y|ies)/?(?:\?page=\d+)?$",
            r"ulab\.edu\.bd/faculty-members(?:-\d+)?/?(?:\?page=\d+)?$",
            r"usb\.ulab\.edu\.bd/(?:[\w-]+/)?faculty/?$",
        ],
        follow=[r"ulab\.edu\.bd/department-[\w-]+/?$", r"^https?://(?:eee|ete|ged|deh|usb|msj|bll|cse)\.ulab\.edu\.bd/?$"],
        profile=[r"usb\.ulab\.edu\.bd/(?:[\w-]+/)?faculty/[\w-]+/?$", r"ulab\.edu\.bd/faculty/[\w-]+-[\w-]+/?$"],
        exclude=[r"/staff/", r"/user/", r"/node/\d+/edit"],
        departments=ULAB,
    ),
    SiteSpec(
        key="buft",
        short_name="BUFT",
        name="BGMEA University of Fashion & Technology",
        homepage="https://buft.edu.bd",
        domains=["buft.edu.bd"],
        starts=["https://buft.edu.bd/"],
        seeds=[f"https://buft.edu.bd/{slug}/teaching-staff" for slug in BUFT],
        listing=[r"buft\.edu\.bd/[\w-]+/teaching-staff/?$"],
        follow=[r"buft\.edu\.bd/(?:department-of-[\w-]+|faculty-of-[\w-]+|[\w-]*institute[\w-]*)/?$"],
        profile=[r"buft\.edu\.bd/(?:faculty|teacher|profile|faculty-profile|teaching-staff)/[\w.-]+/?$"],
        exclude=[r"/contact$", r"/notice", r"/news"],
        departments=BUFT,
    ),
    SiteSpec(
        key="cub",
        short_name="CUB",
        name="Canadian University of Bangladesh",
        homepage="https://cub.edu.bd",
        domains=["cub.edu.bd"],
        starts=["https://cub.edu.bd/", *(f"https://{s}.cub.edu.bd/" for s in CUB_SUBSITES)],
        seeds=["http://home.cub.edu.bd/cub/faculty.php?TA=FacultyReg", "http://home.cub.edu.bd/cub/faculty.php", *(f"https://{s}.cub.edu.bd/{s}/faculty.php" for s in CUB_SUBSITES)],
        listing=[r"cub\.edu\.bd/[\w-]+/faculty\.php(?:\?.*)?$", r"cub\.edu\.bd/faculty(?:_members?|_list)?\.php(?:\?.*)?$"],
        follow=[r"^https?://(?:cse|eee|business|law|english|ged|pbh|mcj)\.cub\.edu\.bd/?(?:[\w-]+/?)?$"],
        profile=[r"faculty_member_details\.php\?faculty=", r"faculty_details\.php\?", r"cub\.edu\.bd/[\w-]+/faculty_details?/[\w-]+"],
        exclude=[r"admission\.php", r"/notice", r"/news"],
        departments=CUB,
    ),
    SiteSpec(
        key="uap",
        short_name="UAP",
        name="University of Asia Pacific",
        homepage="https://www.uap-bd.edu",
        domains=["uap-bd.edu"],
        starts=["https://www.uap-bd.edu/", *(f"https://{s}.uap-bd.edu/" for s in UAP_SUBSITES)],
        seeds=[
            "https://cse.uap-bd.edu/people/faculty/",
            "https://cse.uap-bd.edu/faculty/faculties_list",
            "https://ce.uap-bd.edu/faculty.html",
            "https://ce.uap-bd.edu/faculty_on_leave.html",
            "https://lhr.uap-bd.edu/lhrfaculty1.php",
            "https://www.uap-bd.edu/bsh/faculty.html",
            "https://eee.uap-bd.edu/faculty.html",
            "https://pharmacy.uap-bd.edu/faculty.php",
            "https://arch.uap-bd.edu/faculty.html",
            "https://bba.uap-bd.edu/faculty.html",
            "https://english.uap-bd.edu/faculty.html",
        ],
        listing=[
            r"uap-bd\.edu/(?:[\w-]+/)?faculty(?:_on_leave|_list|[-_]?members?|[-_]full[-_]time|[-_]part[-_]time|\d)?\.(?:html?|php)$",
            r"uap-bd\.edu/people/faculty/?$",
            r"uap-bd\.edu/faculty/faculties_list",
            r"uap-bd\.edu/[\w-]*faculty\d*\.php$",
        ],
        follow=[r"^https?://(?:www\.)?(?:[\w-]+\.)?uap-bd\.edu/(?:[\w-]+/)?(?:index\.(?:html?|php))?$"],
        profile=[r"uap-bd\.edu/people/faculty/[\w.-]+/?$", r"uap-bd\.edu/faculty/(?!faculties_list)[\w.-]+\.(?:php|html?)$"],
        exclude=[r"/news-events/", r"/notice", r"\.pdf$"],
        departments=UAP,
    ),
    SiteSpec(
        key="eub",
        short_name="EUB",
        name="European University of Bangladesh",
        homepage="https://eub.edu.bd",
        domains=["eub.edu.bd"],
        starts=["https://eub.edu.bd/"],
        seeds=["https://eub.edu.bd/department-of-ipe/1000/", "https://eub.edu.bd/faculty/faculty-members"],
        listing=[r"eub\.edu\.bd/department-of-[\w-]+/\d+/?$", r"eub\.edu\.bd/faculty/faculty-members/?$", r"eub\.edu\.bd/[\w-]+/faculty(?:-members)?/?$"],
        follow=[r"eub\.edu\.bd/(?:bachelor|master|bsc|ba|bba|mba|llb|llm|msc|b-sc|m-sc)[\w-]*/?$", r"eub\.edu\.bd/faculty-of-[\w-]+", r"eub\.edu\.bd/departments?/?$"],
        profile=[r"eub\.edu\.bd/faculty/faculty-members/[\w-]{8,}/?$"],
        exclude=[r"/alumni-industry", r"/notice", r"/news", r"/events?/"],
        departments=EUB,
    ),
    SiteSpec(
        key="bubt",
        short_name="BUBT",
        name="Bangladesh University of Business and Technology",
        homepage="https://www.bubt.edu.bd",
        domains=["bubt.edu.bd"],
        blocked=["classic.bubt.edu.bd", "dev.bubt.edu.bd", "newera2026.bubt.edu.bd"],
        starts=["https://www.bubt.edu.bd/", "https://bubt.edu.bd/home/view_all_departments"],
        seeds=[
            *(f"https://www.bubt.edu.bd/department/{slug}/faculty" for slug in BUBT if slug.startswith("department-of-")),
            "https://cse.bubt.edu.bd/faculty",
            "https://www.bubt.edu.bd/home/faculty_member/english",
            "https://www.bubt.edu.bd/home/faculty_member/economics",
        ],
        listing=[r"bubt\.edu\.bd/department/[\w-]+/faculty/?$", r"bubt\.edu\.bd/home/faculty_member/[\w-]+/?$", r"^https?://cse\.bubt\.edu\.bd/faculty/?$"],
        follow=[r"bubt\.edu\.bd/department/(?:department-of-)?[\w-]+/?$", r"bubt\.edu\.bd/department/information/[\w-]+", r"bubt\.edu\.bd/faculty/faculty-of-[\w-]+", r"view_all_departments"],
        profile=[r"/faculty/profile/[\w.-]+/?$", r"/department/member_details/\d+"],
        exclude=[r"/course_details/", r"/dept_menu_details/", r"/notice", r"/news"],
        departments=BUBT,
    ),
    SiteSpec(
        key="prime",
        short_name="PU",
        name="Prime University",
        homepage="https://primeuniversity.ac.bd",
        domains=["primeuniversity.ac.bd", "primeuniversity.edu.bd"],
        starts=["https://primeuniversity.ac.bd/", "https://primeuniversity.ac.bd/department"],
        fallback=["https://www.primeuniversity.edu.bd/department", "https://www.primeuniversity.edu.bd/"],
        seeds=[f"https://primeuniversity.ac.bd/department/{slug}/faculty" for slug in PRIME],
        listing=[r"primeuniversity\.(?:ac|edu)\.bd/(?:index\.php/)?department/[\w-]+/faculty/?$", r"primeuniversity\.(?:ac|edu)\.bd/(?:index\.php/)?department/faculty_member/\d+/?$"],
        follow=[r"primeuniversity\.(?:ac|edu)\.bd/(?:index\.php/)?department/(?:details/\d+|[\w-]+)/?$"],
        profile=[r"faculty-profile\.php\?id=\d+", r"/faculty_member/details/\d+/\d+"],
        exclude=[r"/file/", r"/admin/uploads/.*\.pdf"],
        departments=PRIME,
        profile_ids=("https://primeuniversity.ac.bd/faculty-profile.php?id={id}", 1, 400),
    ),
]
