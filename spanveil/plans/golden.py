"""Small literal inputs with the results that the rules give, for queries that no SQL engine can compute by itself.

Names and addresses are invented. A row of a table takes entry ``key % n``.
"""

from __future__ import annotations

#: (text, previous assistant message, allowlist, expected)
MESSAGES = (
    # introductions
    ("Hello there, my name is Orla Quist and I bake", None, "", "Hello there, my name is <fn_1> <ln_1> and I bake"),
    ("Evening! This is Tam Vey from the bakery on Main", None, "", "Evening! This is <fn_1> <ln_1> from the bakery on Main"),
    ("I'm Bea Penrose", "May I have your name?", "", "I'm <fn_1> <ln_1>"),
    ("I am still waiting for a call back", None, "", "I am still waiting for a call back"),
    ("my nme is Cleo", None, "", "my nme is <fn_1>"),
    # contacts, and names beside them
    ("Reach me under jem.lorne@post.example.org please", None, "", "Reach me under <em_1> please"),
    ("Ring +1 (555) 010-2003.", None, "", "Ring <ph_1>."),
    ("Orla Quist orla@post.example.org", None, "", "<fn_1> <ln_1> <em_1>"),
    ("orla@post.example.org, Orla Quist", None, "", "<em_1>, <fn_1> <ln_1>"),
    ("5550102003 (Bea)", None, "", "<ph_1> (<fn_1>)"),
    ("jem@post.example.org Jem", None, "", "<em_1> Jem"),
    # replies to a prompt
    ("Tamsin", "And what's your first name?", "", "<fn_1>"),
    ("Yep, Tamsin", "What is your first name?", "", "Yep, <fn_1>"),
    ("ok tamsin", "What is your first name?", "", "ok <fn_1>"),
    ("Penrose", "What's your last name?", "", "<ln_1>"),
    ("Penrose, is there parking?", "What's your last name?", "", "<ln_1>, is there parking?"),
    ("bea penrose", "Please tell me your full name.", "", "<fn_1> <ln_1>"),
    ("Bea Penrose, 5550102003", "First and last name, and a phone number?", "", "<fn_1> <ln_1>, <ph_1>"),
    ("Bea Ada Penrose", "Your full name?", "", "<fn_1> <mn1_1> <ln_1>"),
    ("Bea P", "Your full name?", "", "<fn_1> <ln_1>"),
    ("Bea A. Penrose", "What is your first name?", "", "<fn_1> <mn1_1> <ln_1>"),
    ("Jem (Jemima)", "What is your first name?", "", "<fn_1> (<fn_2>)"),
    ("Jem - short for Jemima", "What is your first name?", "", "<fn_1> - short for <fn_2>"),
    ("I would rather not say", "What is your first name?", "", "I would rather not say"),
    ("Next week works", "What is your last name?", "", "Next week works"),
    # labels and keys
    ("Penrose surname", None, "", "<ln_1> surname"),
    ("family name: Penrose", None, "", "family name: <fn_1>"),
    ("Last name Penrose", None, "", "Last name <ln_1>"),
    ("On the form my last name is Penrose", None, "", "On the form my last name is <ln_1>"),
    ("First name: Bea", None, "", "First name: <fn_1>"),
    ("Name - Bea Penrose", None, "", "Name - <fn_1> <ln_1>"),
    ("names: Bea P, mail: bp@post.example.org", None, "", "names: <fn_1> <ln_1>, mail: <em_1>"),
    ("Your name (first and last): Cleo Lorne", None, "", "Your name (first and last): <fn_1> <ln_1>"),
    # signatures and several people
    ("Please confirm that you received my request. Cleo Lorne", None, "", "Please confirm that you received my request. <fn_1> <ln_1>"),
    ("Thanks, I would like to confirm a tour next week - Bea A Penrose", None, "", "Thanks, I would like to confirm a tour next week - <fn_1> <mn1_1> <ln_1>"),
    ("Is the lot still free? Cleo Lorne Lakeside Realty", None, "", "Is the lot still free? <fn_1> <ln_1> Lakeside Realty"),
    ("Do you pay a commission? Bea Penrose C21", None, "", "Do you pay a commission? <fn_1> <ln_1> C21"),
    ("Orla Quist, Tam Vey, brokers, want a tour", None, "", "<fn_1> <ln_1>, <mn1_1> <mn2_1>, brokers, want a tour"),
    ("My buyers Orla Quist and Tam Vey come along", None, "", "My buyers <fn_1> <ln_1> and <fn_2> <ln_2> come along"),
    ("The clients are Orla and Tam Quist, both new", None, "", "The clients are <fn_1> and <mn1_1> <ln_1>, both new"),
    ("ok, Bea Penrose bea@post.example.org", None, "", "ok, <fn_1> <ln_1> <em_1>"),
    # what is no name
    ("Hello Ava", None, "", "Hello Ava"),
    ("Fairmeadow", None, "", "Fairmeadow"),
    ("Fairmeadow Oregon", None, "Fairmeadow", "Fairmeadow Oregon"),
    ("Harbor Point", "Which community do you mean?", "", "Harbor Point"),
    ("Aspen ii", "Which floor plan is it?", "", "Aspen ii"),
    ("Bright Roofing Services", None, "", "Bright Roofing Services"),
    ("Somewhere near Fairmeadow", None, "Fairmeadow", "Somewhere near Fairmeadow"),
    ("North Dakota", None, "", "North Dakota"),
    ("Lakewood West", None, "", "Lakewood West"),
    ("Move in ready", None, "", "Move in ready"),
    ("phone number for the office", None, "", "phone number for the office"),
    ("What does it cost?", None, "", "What does it cost?"),
    ("card 4785380592391139", None, "", "card 4785380592391139"),
)

#: (name, fn, mn1, mn2, ln)
NAMES = (
    ("Orla", "Orla", "", "", ""),
    ("Orla Quist", "Orla", "", "", "Quist"),
    ("Dr. Orla Quist", "Orla", "", "", "Quist"),
    ("Orla and Quist", "Orla", "", "", "Quist"),
    ("Orla Bea Quist", "Orla", "Bea", "", "Quist"),
    ("Orla Bea Cleo Quist", "Orla", "Bea", "Cleo", "Quist"),
    ("mrs Orla Bea Cleo van Quist", "Orla", "Bea", "Cleo", "van Quist"),
    ("Zoë O'Quist-Vey", "Zoë", "", "", "O'Quist-Vey"),
    ("", "", "", "", ""),
)

#: (phrase, is a region phrase, is a location phrase, is a company), with the terms ("windsor", "shadow hills", "new fairview")
PHRASES = (
    ("south carolina", True, False, False),
    ("windsor california", True, False, False),
    ("windsor ca", True, False, False),
    ("northern nevada", True, False, False),
    ("screven county ga", True, False, False),
    ("near windsor", False, True, False),
    ("lots close to windsor", False, True, False),
    ("shadow hills new fairview", False, True, False),
    ("north windsor", True, False, False),
    ("texas", False, False, False),
    ("bright cleaning crew", False, False, True),
    ("crew", False, False, False),
    ("orla quist", False, False, False),
)
TERMS = ("windsor", "shadow hills", "new fairview")

#: (word, blocked)
WORDS = (("yes", True), ("Near", True), ("homes", True), ("services", True), ("northwest", True), ("tx", True), ("Texas", True), ("orla", False), ("york", False), ("quist", False))

#: (text, what follows the acknowledgement, characters skipped, found)
ACKNOWLEDGEMENTS = (("Yes. Orla", "Orla", 5, True), ("Yup, Orla", "Orla", 5, True), ("ok - Orla", "Orla", 5, True), ("Yes", "Yes", 0, False), ("Yesterday", "Yesterday", 0, False), ("sure  ", "sure  ", 0, False))

#: (placeholder, repaired), for the vault below
PLACEHOLDERS = (
    ("<fn_1>", "<fn_1>"),
    ("<FN1>", "<fn_1>"),
    ("<first1>", "<fn_1>"),
    ("<firstname2>", "<fn_2>"),
    ("<email>", "<em_1>"),
    ("<em>", "<em_1>"),
    ("<name>", "<fn_2> <ln_1>"),
    ("< Phone >", "<ph_1>"),
    ("<last>", "<ln_1>"),
    ("<first_name_1>", "<first_name_1>"),
    ("<ph2>", "<ph2>"),
    ("<unknown>", "<unknown>"),
)
VAULT = {"<fn_1>": "Orla", "<fn_2>": "Tam", "<ln_1>": "Quist", "<em_1>": "orla@mail.example.com", "<ph_1>": "555 010 2003"}

#: Prompts with what they ask for, and whether they are about plans or places.
PROMPTS = (
    ("What is your  First name?", "first", False, False),
    ("I have your first name. Last name?", "last", False, False),
    ("Please share your first and last name.", "full", False, False),
    ("What's your surname?", "last", False, False),
    ("Could you share your contact info?", None, False, False),
    ("What's your name and best contact info?", "full", False, False),
    ("May I have your name?", "first", False, False),
    ("Which floor plan do you like?", None, True, False),
    ("Which community are you looking at?", None, False, True),
    ("Shall we compare plans in nearby communities?", None, True, True),
    ("How are you?", None, False, False),
    ("", None, False, False),
)

#: (a, b, similar): pairs of name tokens
TOKENS = (("frew", "free", True), ("edwibn", "edwin", True), ("orla", "orla", True), ("orla", "quist", False), ("al", "alexander", False), ("", "orla", False))

#: (text, nearly one of the terms "cypress ii", "redbud", "shadow hills")
NEARLY = (("Cypress IO", True), ("Shadow Hill", True), ("Redbuds", False), ("Redbud", True), ("Willow", False), ("Shadow", False))

FIRST = ("Orla", "Tamsin", "Jem", "Bea", "Cleo")
LAST = ("Quist", "Vey", "Lorne", "Penrose")
