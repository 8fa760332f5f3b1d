"""Schemas of the raw records, the tables and the dimensions."""

from __future__ import annotations





RAW_MESSAGE = (
    "listserv string, archive_id string, source_url string, subject string, author_name string, author_email string, sent_at timestamp, body_html string, body_text string, complete boolean, "
    "headers struct<identity_fields: array<string>, rfc_message_id: string, recipient_lists: array<string>, headers_complete: boolean>, attachments array<struct<url: string, type: string>>, via_hoagie boolean"
)
MEDIA = "array<struct<id: string, url: string, kind: string, name: string, alt: string, width: int, height: int>>"
MESSAGES = (
    "id string, listserv string, archive_id string, source_url string, subject string, sender_name string, sender_email string, via string, sender_attribution string, sent_at timestamp, preview string, "
    f"body_text string, body_html string, complete boolean, links array<string>, media {MEDIA}, rfc_message_id string, delivery_key string, headers_complete boolean, canonical_id string, category string, "
    "organization_id string, organization_name string, org_confidence string, org_evidence struct<evidence: array<string>, hash: string>, classifier_version string, extraction_version string, extraction_method string, "
    "is_event boolean, extraction_notes array<string>, ingested_at timestamp, updated_at timestamp, revision long"
)
MESSAGE_LISTS = ("message_id string, listserv string")
EVENTS = (
    "id string, source string, message_id string, idx int, external_id string, external_url string, image_url string, status string, duplicate_of string, title string, summary string, starts_at timestamp, ends_at timestamp, "
    "time_precision string, location_text string, location_id string, location_name string, latitude double, longitude double, room string, online boolean, tags array<string>, free_food boolean, rsvp_url string, "
    "host_org_id string, host_org_name string, confidence double, publishable boolean, extraction_version string, series_id string, series_size int, created_at timestamp, updated_at timestamp, revision long"
)
SOURCES = ("listserv string, last_polled_at timestamp, last_success_at timestamp, last_error string, failures int")
PROFILE = "struct<tagline: string, description: string, whatWeDo: string, goals: string, website: string, email: string, instagram: string, facebook: string, linkedin: string, twitter: string, youtube: string, acronym: string, memberCount: int>"
DIRECTORY = (f"id string, name string, group_type string, categories array<string>, profile {PROFILE}")
OVERRIDES = ("id string, name string, aliases array<string>, group_type string, categories array<string>, urls array<string>, url_subdomains boolean, sources array<string>")
ORGANIZATIONS = (f"id string, name string, aliases array<string>, group_type string, categories array<string>, urls array<string>, url_subdomains boolean, sources array<string>, profile {PROFILE}")
LOCATIONS = ("id string, name string, aliases array<string>, category string, latitude double, longitude double, source string")
POIS = ("id int, name string, alt_name string, class string, type string, lat double, long double, parent_id int")
LOCATION_OVERRIDES = ("id string, name string, category string, aliases array<string>, drop boolean")
EXTRACTED = (
    "array<struct<title: string, summary: string, starts_at: timestamp, ends_at: timestamp, time_precision: string, location_text: string, location_id: string, location_name: string, latitude: double, longitude: double, "
    "room: string, online: boolean, tags: array<string>, free_food: boolean, rsvp_url: string, host_org_id: string, host_org_name: string, confidence: double, publishable: boolean>>"
)
FEED_ITEM = (", ".join(f"{c} string" for c in (
    "eventId", "title", "groupId", "group", "eventStartDateTime", "start", "eventEndDateTime", "end", "eventLocation", "locationType", "fullDescription", "description", "eventTopics", "foodProvided", "allDayEvent",
    "eventLink", "link", "eventPhotoFullUrl", "eventFlyerFullUrl", "eventDelete", "externalRegistrationLink", "eventExternalRegistrationLink",
)).replace("group string", "`group` string").replace("end string", "`end` string"))
