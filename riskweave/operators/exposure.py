"""Who can reach an object: exposure rank 0 PRIVATE, 1 INTERNAL, 2 ORG_WIDE, 3 PUBLIC from a vendor's settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIVATE, INTERNAL, ORG_WIDE, PUBLIC = range(4)

# Well-known identifiers and names of Windows trustees.
SIDS = {"S-1-1-0": 3, "S-1-5-7": 3, "S-1-0-0": 3, "S-1-5-11": 2, "S-1-5-32-545": 2, "S-1-5-32-546": 2, "S-1-5-32-544": 1, "S-1-5-18": 1, "S-1-5-19": 1, "S-1-5-20": 1, "S-1-3-0": 0, "S-1-3-1": 0}
TRUSTEES = {
    "anonymous logon": 3, "anonymous": 3, "null sid": 3, "everyone": 2, "authenticated users": 2, "builtin\\users": 2, "builtin\\guests": 2, "users": 2,
    "domain users": 1, "domain admins": 1, "domain computers": 1, "enterprise admins": 1, "builtin\\administrators": 1, "administrators": 1, "system": 1, "local service": 1, "network service": 1,
    "creator owner": 0, "creator group": 0,
}
SCOPES = {"anonymous": 3, "anyone": 3, "organization": 2, "company": 2, "existingaccess": 0, "users": 0, "specificpeople": 0}
SEVERITY = {1: 0.65, 2: 0.75, 3: 0.85, 4: 0.95}
LIKELIHOOD = {"VERY_UNLIKELY": 0.50, "UNLIKELY": 0.60, "POSSIBLE": 0.75, "LIKELY": 0.85, "VERY_LIKELY": 0.95}


def _lookup(x: Column, table: dict, otherwise=None) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def _yes(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def _most(ranks: Column) -> Column:
    return F.coalesce(F.array_max(ranks), F.lit(PRIVATE))


def severity_confidence(c: Column) -> Column:
    return F.coalesce(_lookup(c, SEVERITY), F.lit(0.75))


def likelihood_confidence(c: Column) -> Column:
    return F.coalesce(_lookup(F.upper(c), LIKELIHOOD), F.lit(0.75))


def s3(acl: Column, public_access_block: Column, website: Column, policy_public: Column, cross_account: Column, policy_conditional: Column) -> Column:
    """A missing public access block counts as on; it covers public policies and lists, not websites."""
    open_ = ~F.coalesce(public_access_block.cast("boolean"), F.lit(True))
    acl = F.lower(F.coalesce(acl, F.lit("private")))
    return (
        F.when(_yes(website) | open_ & (_yes(policy_public) | F.contains(acl, F.lit("public-read"))), PUBLIC)
        .when(open_ & F.contains(acl, F.lit("authenticated-read")) | _yes(cross_account), ORG_WIDE)
        .when(_yes(policy_conditional) | ~acl.isin("private", "bucket-owner-full-control", "bucket-owner-read"), INTERNAL)
        .otherwise(PRIVATE)
    )


def s3_encryption(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), "none").when(F.contains(F.lower(c), F.lit("kms")), "customer_managed").otherwise("platform")


def gcs(members: Column, acl_entities: Column, prevention_enforced: Column, cross_project: Column) -> Column:
    """The widest of IAM members and access list entries; enforced prevention leaves only other projects."""
    member = lambda m: F.when(m == "allUsers", PUBLIC).when(m == "allAuthenticatedUsers", ORG_WIDE).when(m.rlike("^(domain|group|project(Viewer|Editor|Owner)):"), INTERNAL).otherwise(PRIVATE)
    entity = lambda e: F.when(e == "allUsers", PUBLIC).when(e == "allAuthenticatedUsers", ORG_WIDE).when(F.startswith(e, F.lit("project-")), INTERNAL).otherwise(PRIVATE)
    widest = F.greatest(_most(F.transform(members, member)), _most(F.transform(acl_entities, entity)))
    other = F.when(_yes(cross_project), ORG_WIDE).otherwise(PRIVATE)
    return F.when(_yes(prevention_enforced), other).otherwise(F.greatest(widest, other))


def blob(access_level: Column, default_action: Column, rules: Column, sas: Column, cross_tenant: Column, private_endpoint: Column) -> Column:
    """rules: number of network rules; sas: rank of the shared access signature."""
    level = F.lower(F.coalesce(access_level, F.lit("private")))
    return (
        F.when(_yes(private_endpoint), F.when(_yes(cross_tenant), ORG_WIDE).otherwise(PRIVATE))
        .when((level == "container") | (sas == PUBLIC), PUBLIC)
        .when((level == "blob") | (default_action == "Allow") & (F.coalesce(rules, F.lit(0)) == 0), ORG_WIDE)
        .when(F.coalesce(rules, F.lit(0)) > 0, INTERNAL)
        .when(_yes(cross_tenant), ORG_WIDE)
        .otherwise(F.coalesce(sas, F.lit(PRIVATE)))
    )


def sas(has_public: Column, configured: Column, no_expiry: Column, permissions: Column, has_expiry: Column) -> Column:
    everything = F.contains(permissions, F.lit("d")) & F.contains(permissions, F.lit("w")) & F.contains(permissions, F.lit("r"))
    return (
        F.when(_yes(has_public), PUBLIC).when(~_yes(configured), PRIVATE)
        .when(_yes(no_expiry) | F.coalesce(everything, F.lit(False)), ORG_WIDE)
        .when(F.coalesce(has_expiry, F.lit(True)), INTERNAL).otherwise(PRIVATE)
    )


def trustee(name: Column, sid: Column) -> Column:
    """By identifier, then by name, with its domain or without, then by a name that it holds; others are single accounts."""
    low = F.lower(F.trim(name))
    qualified = F.contains(low, F.lit("\\"))
    local = F.when(qualified, _lookup(F.substring_index(low, "\\", -1), TRUSTEES))
    domain = F.when(qualified & (F.contains(low, F.lit("domain users")) | F.contains(low, F.lit("domain admins"))), INTERNAL)
    part = F.lit(PRIVATE)
    for k, v in reversed(TRUSTEES.items()):
        part = F.when(F.contains(low, F.lit(k)), v).otherwise(part)
    return F.coalesce(_lookup(sid, SIDS), _lookup(low, TRUSTEES), local, domain, part)


def ntfs(aces: Column, share: Column) -> Column:
    """The widest trustee that is allowed to read; arrays of struct(trustee, sid, type, permissions)."""
    readers = F.lit(["read", "read_execute", "modify", "full_control", "list", "generic_read", "generic_all"])
    rank = lambda a: F.when((F.lower(a["type"]) == "allow") & F.arrays_overlap(a["permissions"], readers), trustee(a["trustee"], a["sid"])).otherwise(PRIVATE)
    return F.greatest(_most(F.transform(aces, rank)), _most(F.transform(share, rank)))


def nfs_host(host: Column) -> Column:
    h = F.trim(host)
    prefix = F.split_part(h, F.lit("/"), F.lit(-1)).try_cast("int")
    network = F.when(prefix.isNull(), INTERNAL).when(prefix >= 32, PRIVATE).when(prefix >= 24, INTERNAL).when(prefix >= 16, ORG_WIDE).otherwise(PUBLIC)
    return F.when(h.isin("*", ""), PUBLIC).when(F.contains(h, F.lit("/")), network).when(h.rlike(r"[*?]"), F.when(F.startswith(h, F.lit("*.")), INTERNAL).otherwise(ORG_WIDE)).otherwise(PRIVATE)


def nfs_client(host: Column, options: Column) -> Column:
    """Kerberos narrows an organisation-wide export; insecure options and remote root widen others."""
    base = nfs_host(host)
    has = lambda o: F.coalesce(F.array_contains(options, o), F.lit(False))
    kerberos = F.coalesce(F.exists(options, lambda o: F.lower(o).isin("sec=krb5", "sec=krb5i", "sec=krb5p")), F.lit(False))
    weak = has("insecure") | has("no_auth_nlm")
    return (
        F.when(kerberos, F.when(base == ORG_WIDE, INTERNAL).otherwise(base)).when(weak & (base >= ORG_WIDE), PUBLIC)
        .when(weak | has("no_root_squash"), F.greatest(base, F.lit(ORG_WIDE))).otherwise(base)
    )


def world_readable(mode: Column) -> Column:
    """Symbolic modes by their eighth letter, digits with a leading 0 as octal, other digits as decimal."""
    number = F.when(F.startswith(mode, F.lit("0")), F.conv(mode, 8, 10)).otherwise(mode).try_cast("int")
    return F.coalesce(F.when(mode.rlike("^[-d]"), F.substring(mode, 8, 1) == "r").otherwise(number.bitwiseAND(4) != 0), F.lit(False))


def nfs(clients: Column, mode: Column) -> Column:
    """clients: array of struct(host, options)."""
    wildcard = F.coalesce(F.exists(clients, lambda c: F.trim(c["host"]) == "*"), F.lit(False))
    return F.when(world_readable(mode) & wildcard, PUBLIC).otherwise(_most(F.transform(clients, lambda c: nfs_client(c["host"], c["options"]))))


def sharing_link(scope: Column, has_password: Column, expires: Column, requires_sign_in: Column) -> Column:
    s = F.lower(scope)
    return F.when(s.isin("organization", "company") & ~F.coalesce(requires_sign_in, F.lit(True)), PUBLIC).otherwise(_lookup(s, SCOPES, PRIVATE))


def m365(links: Column, direct: Column, site_capability: Column) -> Column:
    """links: array of struct(scope, hasPassword, expirationDateTime, requiresSignIn); direct: array of ranks."""
    widest = F.greatest(_most(F.transform(links, lambda x: sharing_link(x["scope"], x["hasPassword"], x["expirationDateTime"], x["requiresSignIn"]))), _most(direct))
    outside = F.contains(F.lower(F.coalesce(site_capability, F.lit(""))), F.lit("external"))
    return F.when(outside & (widest == INTERNAL), ORG_WIDE).otherwise(widest)


def posix(mode: Column) -> Column:
    """From the permission bits: others may write or read, the group may read."""
    return F.when(mode.bitwiseAND(2) != 0, PUBLIC).when(mode.bitwiseAND(4) != 0, ORG_WIDE).when(mode.bitwiseAND(0o040) != 0, INTERNAL).otherwise(PRIVATE)


def direct_permission(granted: Column) -> Column:
    """granted: struct(site, group, user_email, user_type, application) of a permission, null where it has none."""
    group, email = F.lower(granted["group"]), F.lower(F.coalesce(granted["user_email"], F.lit("")))
    guest = F.contains(email, F.lit("#ext#")) | (F.coalesce(granted["user_type"], F.lit("")) == "Guest")
    user = granted["user_email"].isNotNull() | granted["user_type"].isNotNull()
    return (
        F.when(granted["site"].isNotNull(), INTERNAL).when(group.isNotNull(), F.when(F.contains(group, F.lit("everyone")), ORG_WIDE).otherwise(INTERNAL))
        .when(user, F.when(guest, ORG_WIDE).otherwise(PRIVATE)).when(granted["application"].isNotNull(), INTERNAL).otherwise(PRIVATE)
    )


def crosses_projects(members: Column, project: Column) -> Column:
    """Whether a service account among the members is of another project; false where the project is not known."""
    foreign = F.exists(members, lambda m: F.contains(m, F.lit("serviceAccount:")) & ~F.contains(m, F.concat(F.lit("@"), project)))
    return F.coalesce((F.length(project) > 0) & foreign, F.lit(False))


def recommended_mode(rank: Column, is_directory: Column, is_executable: Column) -> Column:
    """The permission bits that an exposure calls for."""
    folder = F.when(rank == PRIVATE, 0o700).when(rank == INTERNAL, 0o750).when(rank == ORG_WIDE, 0o755).otherwise(0o777)
    file = F.when(rank == PRIVATE, 0o600).when(rank == INTERNAL, 0o640).when(rank == ORG_WIDE, 0o644).otherwise(0o666)
    return F.when(is_directory, folder).otherwise(file + F.when(is_executable & (rank < PUBLIC), 0o100).otherwise(0))


# Bits of a Windows access mask.
RIGHTS = {
    0x1: "READ_DATA", 0x2: "WRITE_DATA", 0x4: "APPEND_DATA", 0x8: "READ_EA", 0x10: "WRITE_EA", 0x20: "EXECUTE", 0x40: "DELETE_CHILD", 0x80: "READ_ATTRIBUTES", 0x100: "WRITE_ATTRIBUTES",
    0x10000: "DELETE", 0x20000: "READ_CONTROL", 0x40000: "WRITE_DAC", 0x80000: "WRITE_OWNER", 0x100000: "SYNCHRONIZE",
    0x10000000: "GENERIC_ALL", 0x80000000: "GENERIC_READ", 0x40000000: "GENERIC_WRITE", 0x20000000: "GENERIC_EXECUTE",
}


def rights(mask: Column) -> Column:
    """The names of the bits of an access mask; its hexadecimal form if it has none of them."""
    wide = mask.cast("long")
    found = F.filter(F.array(*[F.when(wide.bitwiseAND(bit) != 0, name) for bit, name in RIGHTS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(wide)), 8, "0"))))
