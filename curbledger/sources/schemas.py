"""Table schemas of the data model: Spark types, required columns, defaults, computed columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbledger.functions.calendar import yrmo

MONEY = "decimal(15,2)"
STAMP = "timestamp_ntz"
NOW = object()  # default: the time of the load
BUCKETS = 32    # parts of a table that is changed by id


@dataclass(frozen=True)
class Table:
    """`columns` maps a name to its type; a trailing "?" allows NULL."""

    columns: Mapping[str, str]
    defaults: Mapping[str, object] = field(default_factory=dict)
    computed: Mapping[str, Column] = field(default_factory=dict)
    part_name: str = "part_no"  # the column that tells the parts of the table apart
    bucket_of: str = ""         # parts are buckets of this id; else all rows are in part 0

    def part(self) -> Column:
        """Part of a row, where it is not a column of the table."""
        return F.pmod(F.col(self.bucket_of), F.lit(BUCKETS)).cast("int") if self.bucket_of else F.lit(0)

    def schema(self) -> T.StructType:
        """Stored columns (computed ones are added on read)."""
        return T.StructType([
            T.StructField(name, T.DataType.fromDDL(kind.rstrip("?")), kind.endswith("?"))
            for name, kind in self.columns.items()
        ])


_EDITED = {"create_dtm": STAMP, "mod_dtm": STAMP, "mod_by": "string"}
_STAMPED = {"create_dtm": NOW, "mod_dtm": NOW}

_BILL = {
    "company": "string", "ix_yrmo": "int", "uid": "int", "cd_license": "string", "bill_type": "smallint",
    "create_dtm": STAMP, "amount": MONEY, "discount": MONEY, "bill_start": "date", "bill_end": "date", "due_dtm": STAMP,
}


def _cheque_number() -> Column:
    return F.when(F.col("payment_type") == "Q", F.right("ref_code", F.lit(7)))


def tables() -> dict[str, Table]:
    """All tables.  A function, since computed columns need a running Spark session."""
    return {
        "system_config": Table({"dict_key": "string", "grp_key": "string", "c_value1": "string", "c_value2": "string?", "c_order": "int"}),
        "audit_trail": Table(
            {"req_dtm": STAMP, "req_ip": "string", "http_method": "string", "req_url": "string", "login_name": "string"},
            {"req_dtm": NOW},
        ),
        "audit_error": Table({"create_dtm": STAMP + "?", "caller_class": "string?", "caller_member": "string?", "msg": "string?"}),
        "service_location": Table(
            {"srv_dis": "string", "srv_loc": "smallint", "mgt_dis": "string", "cd_fleet": "string", "lhs_cmr": "boolean",
             "name_zh": "string", "name_en": "string?", "srv_addr": "string?", "lat": "double?", "lng": "double?", "mpf": "boolean"},
            {"lhs_cmr": False, "mpf": False},
        ),
        "service_plan": Table(
            {"srv_dis": "string", "srv_loc": "smallint", "company": "string", "cd_plan": "string", "vh_type": "smallint",
             "price": MONEY, "salary": MONEY, "effect": "date", "create_dtm": STAMP, "create_by": "string"},
            {"create_dtm": NOW, "create_by": "#sa"},
        ),
        "account": Table(
            {"id": "int", "login_name": "string?", "display_name": "string", "role": "string", "active": "boolean",
             **_EDITED, "remarks": "string?"},
            {"active": True, **_STAMPED, "mod_by": "#sa"},
        ),
        "contact": Table(
            {"uid": "int", "c_type": "smallint", "c_sal": "string", "c_name": "string", "c_num": "string", "c_addr": "string?", "mod_dtm": STAMP},
            {"c_sal": "", "c_num": "", "mod_dtm": NOW},
        ),
        "customer": Table(
            {"id": "int", "whatsapp": "string?", "email": "string?", "last_reunion": STAMP, "last_payment": STAMP + "?", "balance": MONEY,
             "is_mobill": "boolean", "is_rtn_envelope": "boolean", "is_print_bill": "boolean", "mod_dtm": STAMP, "mod_by": "string"},
            {"last_reunion": NOW, "balance": 0, "is_mobill": False, "is_rtn_envelope": False, "is_print_bill": False, "mod_dtm": NOW},
            bucket_of="id",
        ),
        "employee": Table(
            {"uid": "int", "hkid": "string?", "employ_dtm": "date", "resign_dtm": "date?", "supervisor": "int?", "is_manager": "boolean", **_EDITED},
            {"is_manager": False, **_STAMPED},
        ),
        "employee_contract": Table(
            {"uid": "int", "start_dtm": "date", "end_dtm": "date?", "title": "string", "c_rank": "string?", "salary": MONEY, "al_count": "int", **_EDITED},
            {"salary": 0, "al_count": 7, **_STAMPED},
        ),
        "worker": Table(
            {"uid": "int", "worker_code": "string", "work_type": "string", "salary_a": "int?", "salary_b": "int?", "salary_c": "int?",
             "bonus_a": "int", "bonus_b": "int", "bonus_c": "int", "bonus_extra": "int", "allowance": "int",
             "calc_wax_sal": "boolean", "calc_rot_sal": "boolean", "sal_rot": "int?", "sal_wax": "int?"},
            {"work_type": "", "allowance": 0, "calc_wax_sal": True, "calc_rot_sal": True},
        ),
        "worker_location": Table(
            {"uid": "int", "srv_dis": "string", "srv_loc": "smallint", "srv_floor": "string?", "work_type": "smallint", **_EDITED},
            {"work_type": 0, **_STAMPED},
        ),
        "leave": Table(
            {"uid": "int", "leave_type": "smallint", "pay_ratio": "decimal(5,4)", "leave_dtm": "date", "mod_dtm": STAMP, "mod_by": "string"},
            {"leave_type": 0, "pay_ratio": 0, "mod_dtm": NOW},
        ),
        "vehicle": Table(
            {"cd_license": "string", "owner_id": "int", "vh_type": "smallint", "source": "smallint", "color": "string?", "brand": "string?",
             "model": "string?", **_EDITED, "deleted": "boolean", "remarks": "string?"},
            {"source": 0, "deleted": False, **_STAMPED},
        ),
        "vehicle_service": Table(
            {"company": "string", "cd_license": "string", "owner_id": "int", "vh_type": "smallint", "srv_plan": "string", "reg_dtm": "date",
             "start_dtm": "date", "end_dtm": "date?", "fee": MONEY, "srv_dis": "string", "srv_loc": "smallint", "srv_floor": "string",
             "srv_psn": "string", "weekday1": "smallint", "weekday2": "smallint", "weekday3": "smallint", "rotation": "string?",
             "extra_fee": MONEY, "waxing": "boolean", "worker": "int", "create_dtm": STAMP, "create_by": "string"},
            {"fee": 0, "extra_fee": 0, "waxing": False, "create_dtm": NOW},
        ),
        "unit_service_group": Table({"id": "int", "grp_name": "string", "parent_id": "int?"}),
        "unit_service": Table(
            {"id": "int", "srv_grp": "int", "srv_name": "string", "srv_desc": "string", "srv_img": "string?", "price": MONEY,
             "create_dtm": STAMP, "mod_dtm": STAMP, "mod_by": "string?"},
            _STAMPED,
        ),
        "service_order": Table(
            {"id": "int", "company": "string", "cust_id": "int", "cd_license": "string?", "o_status": "smallint", "payment_type": "string",
             "payment_ref": "string?", "payment_amount": MONEY, "order_dtm": STAMP, "create_dtm": STAMP, "mod_dtm": STAMP, "mod_by": "string?",
             "srv_addr": "string?", "remarks": "string?"},
            {"o_status": 0, "payment_amount": 0, "order_dtm": NOW, **_STAMPED},
            {"ix_yrmo": yrmo(F.col("order_dtm"))},
        ),
        "order_item": Table(
            {"oid": "int?", "item_id": "int?", "qty": "int?", "unit_price": MONEY + "?", "discount": MONEY + "?", "delivery_dtm": STAMP + "?"}
        ),
        "suspended_service": Table(
            {"company": "string", "cd_license": "string", "owner_id": "int", "srv_plan": "string", "reg_dtm": "date", "end_dtm": "date",
             "fee": MONEY, "extra_fee": MONEY, "worker": "int", "worker_name": "string", "reason_id": "smallint", "is_terminate": "boolean",
             "remarks": "string?", "create_dtm": STAMP, "create_by": "string"},
            {"fee": 0, "extra_fee": 0, "create_dtm": NOW},
            {"ix_yrmo": yrmo(F.col("end_dtm")), "cix_yrmo": yrmo(F.col("create_dtm"))},
        ),
        "bill": Table({**_BILL, "remarks": "string?"}, {"create_dtm": NOW}, part_name="ix_yrmo"),
        "bill_archive": Table({**_BILL, "iv_ix": "int?", "iv_seq": "int?", "remarks": "string?"}, part_name="ix_yrmo"),
        "payment": Table(
            {"company": "string", "ix_yrmo": "int", "uid": "int", "useq": "int", "part": "int", "cd_license": "string", "cust_name": "string", "amount": MONEY,
             "payment_type": "string", "ref_code": "string?", "transfer_dtm": STAMP + "?", "create_dtm": STAMP, "create_by": "string",
             "mod_dtm": STAMP, "mod_by": "string", "remarks": "string?"},
            {"part": 0, **_STAMPED}, {"ix_chq": _cheque_number()}, "ix_yrmo",
        ),
        "id_registry": Table({"login_key": "string", "id": "int"}),
        "load_login": Table({"cd_license": "string", "c_name": "string?", "c_num": "string?", "owner": "string?", "login_name": "string?"}),
        "load_stage": Table({"load_name": "string", "stage": "string", "done_dtm": STAMP}),
        "print_config": Table({"company": "string", "print_id": "string", "split": "int", "background": "binary?", "fields": "string"}),
        "invoice_send_log": Table(
            {"id": "int", "company": "string", "cd_license": "string", "sent_type": "string", "media_type": "string", "create_dtm": STAMP,
             "sent_by": "string", "succeed": "boolean"},
            {"create_dtm": NOW, "succeed": False},
        ),
    }
