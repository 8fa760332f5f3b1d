"""Synthetic dimensions that tests share."""

from datetime import datetime, timezone

from quillmesh import schemas
from quillmesh.operators import dims

NONE = (None,) * 13


def profile(**given):
    names = ("tagline", "description", "whatWeDo", "goals", "website", "email", "instagram", "facebook", "linkedin", "twitter", "youtube", "acronym", "memberCount")
    return tuple(given.get(n) for n in names)


def organizations(spark):
    directory = spark.createDataFrame(
        [
            ("mpu:52941", "ACM", "Student organization", ["Academic"], profile(acronym="ACM", instagram="https://instagram.com/x")),
            ("mpu:71474", "Orangehat Cybersecurity Collective", "Student organization", ["Academic"], profile()),
            ("mpu:70043", "Campus Apps", "Student organization", [], profile()),
            ("department:math", "Mathematics", "Academic Department", [], profile(website="https://www.math.princeton.edu/")),
            ("mpu:1", "Chess Circle", "Student organization", ["Sports/Recreation"], profile(email="chesscircle@princeton.edu")),
            ("mpu:2", "Twin Name", "Student organization", ["Music"], profile()), ("mpu:3", "Twin Name", "Campus Rec", [], profile()),
            ("mpu:4", "Players, Princeton University", "Student organization", ["Performing Arts"], profile()),
        ],
        schemas.DIRECTORY,
    )
    overrides = spark.createDataFrame(
        [
            ("mpu:71474", None, ["OrangeHat"], None, None, None, None, None),
            ("mpu:70043", None, None, None, None, ["https://campusapps.org/"], False, None),
            ("plaintext", "plaintext", None, None, None, None, None, ["curated"]),
        ],
        schemas.OVERRIDES,
    )
    return dims.registry(directory, overrides)


def locations(spark):
    return spark.createDataFrame(
        [
            ("mccosh-hall", "McCosh Hall", ["McCosh"], "academic", 40.348, -74.656, "map"), ("frist-campus-center", "Frist Campus Center", ["Frist", "Frist MPR"], "social", 40.346, -74.655, "map"),
            ("engineering-quadrangle", "Engineering Quadrangle", ["E-Quad"], "academic", 40.35, -74.65, "map"), ("friend-center", "Friend Center", [], "academic", 40.35, -74.653, "map"),
            ("whitman-college", "Whitman College", ["Whitman"], "residential", 40.344, -74.658, "map"), ("online", "Online", ["Zoom", "Virtual"], "other", 0.0, 0.0, "curated"), ("tiger-inn", "Tiger Inn", ["TI"], "social", 40.348, -74.652, "map"),
        ],
        schemas.LOCATIONS,
    )


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc).replace(tzinfo=None)
