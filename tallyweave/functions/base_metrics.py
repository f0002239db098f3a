"""Base metric dictionary: fixed values.

One metric per line, in precedence order (the first definition that matches a
label wins).  Columns, separated by a vertical bar:

    code | Chinese name | English name | statement | nature | parent | phrases | exact labels

Several phrases or labels are separated by a semicolon.
"""

# Codes, names and label patterns that results depend on.
BASE_METRICS = """
revenue | 营业收入 |  | income | flow |  | 营业收入;主营业务收入;营业总收入;revenue |
main_business_revenue | 主营业务收入 | Main Business Revenue | income | flow | revenue | 主营业务收入 | 主营业务
other_business_revenue | 其他业务收入 | Other Business Revenue | income | flow | revenue | 其他业务收入 | 其他业务
operating_cost | 营业成本 |  | income | flow |  | 营业成本;主营业务成本 |
operating_total_cost | 营业总成本 |  | income | flow |  | 营业总成本 |
selling_expense | 销售费用 |  | income | flow |  | 销售费用 |
admin_expense | 管理费用 |  | income | flow |  | 管理费用 |
office_expense | 办公费 | Office Expense | income | flow | admin_expense | 办公费 | 办公费
entertainment_expense | 业务招待费 | Entertainment Expense | income | flow | admin_expense | 业务招待费 | 业务招待费
service_fee | 服务费 | Service Fee | income | flow | admin_expense | 服务费 | 服务费
employee_compensation | 职工薪酬 | Employee Compensation | income | flow |  | 职工薪酬 |
rd_expense | 研发费用 |  | income | flow |  | 研发费用 |
travel_expense | 差旅费 | Travel Expense | income | flow |  | 差旅费 |
vehicle_expense | 车辆费用 | Vehicle Expense | income | flow |  | 车辆费用 |
insurance_expense | 保险费 | Insurance Expense | income | flow |  | 保险费 |
lease_expense | 租赁费 | Lease Expense | income | flow |  | 租赁费;资产租赁费用 |
finance_expense | 财务费用 |  | income | flow |  | 财务费用 |
taxes_and_surcharges | 税金及附加 |  | income | flow |  | 税金及附加;印花税;房产税;城市维护建设税;土地使用税;资源税;环境保护税 |
interest_income | 利息收入 |  | income | flow |  | 利息收入 |
interest_expense | 利息费用 |  | income | flow |  | 利息费用 |
other_income | 其他收益 |  | income | flow |  | 其他收益;保险赔偿;废品销售 |
investment_income | 投资收益 |  | income | flow |  | 投资收益;投资损失 |
investment_income_associates | 对联营企业和合营企业的投资收益 | Investment Income From Associates And Joint Ventures | income | flow | investment_income | 对联营企业和合营企业的投资收益;联营企业和合营企业投资收益 |
credit_impairment_loss | 信用减值损失 |  | income | flow |  | 信用减值损失 |
asset_impairment_loss | 资产减值损失 |  | income | flow |  | 资产减值损失 |
asset_disposal_income | 资产处置收益 |  | income | flow |  | 资产处置收益;固定资产报废损失;处置固定资产、无形资产和其他长期资产的损失 |
fair_value_change_gain | 公允价值变动收益 |  | income | flow |  | 公允价值变动收益;公允价值变动损失 |
non_operating_income | 营业外收入 |  | income | flow |  | 营业外收入 |
non_operating_expense | 营业外支出 |  | income | flow |  | 营业外支出 |
operating_profit | 营业利润 |  | income | flow |  | 营业利润 |
total_profit | 利润总额 |  | income | flow |  | 利润总额 |
income_tax | 所得税费用 |  | income | flow |  | 所得税费用;所得税 |
net_profit | 净利润 |  | income | flow |  | 净利润;净收益 |
net_profit_continuing | 持续经营净利润 |  | income | flow | net_profit | 持续经营净利润 |
net_profit_parent | 归属于母公司股东的净利润 |  | income | flow |  | 归属于母公司股东的净利润;归母净利润;归属于母公司所有者的净利润 |
net_profit_minority | 少数股东损益 |  | income | flow |  | 少数股东损益 |
other_comprehensive_income_net | 其他综合收益的税后净额 |  | income | flow |  | 其他综合收益的税后净额;归属母公司所有者的其他综合收益的税后净额 |
other_comprehensive_income_reclassifiable | 将重分类进损益的其他综合收益 |  | income | flow | other_comprehensive_income_net | 将重分类进损益的其他综合收益 |
other_comprehensive_income_not_reclassifiable | 不能重分类进损益的其他综合收益 |  | income | flow | other_comprehensive_income_net | 不能重分类进损益的其他综合收益 |
oci_fv_change_other_equity_investments | 其他权益工具投资公允价值变动 |  | income | flow | other_comprehensive_income_not_reclassifiable | 其他权益工具投资公允价值变动 |
total_comprehensive_income | 综合收益总额 |  | income | flow |  | 综合收益总额 |
total_comprehensive_income_parent | 归属于母公司所有者的综合收益总额 |  | income | flow | total_comprehensive_income | 归属于母公司所有者的综合收益总额;归属于母公司股东的综合收益总额;归属母公司所有者的综合收益总额 |
total_comprehensive_income_minority | 归属于少数股东的综合收益总额 |  | income | flow | total_comprehensive_income | 归属于少数股东的综合收益总额 |
eps_basic | 基本每股收益 |  | income | ratio |  | 基本每股收益 |
eps_diluted | 稀释每股收益 |  | income | ratio |  | 稀释每股收益 |
cash_and_cash_equivalents | 货币资金 |  | balance | stock |  | 货币资金;现金及现金等价物 |
security_deposit | 保证金 | Security Deposit | balance | stock | other_receivables | 保证金 | 保证金
notes_receivable | 应收票据 |  | balance | stock |  | 应收票据 |
accounts_receivable | 应收账款 |  | balance | stock |  | 应收账款 |
prepayments | 预付款项 |  | balance | stock |  | 预付款项 |
other_receivables | 其他应收款 |  | balance | stock |  | 其他应收款 |
dividends_receivable | 应收股利 |  | balance | stock | other_receivables | 应收股利 |
inventory | 存货 |  | balance | stock |  | 存货 |
trading_financial_assets | 交易性金融资产 |  | balance | stock |  | 交易性金融资产 |
current_assets_total | 流动资产合计 |  | balance | stock |  | 流动资产合计 |
other_current_assets | 其他流动资产 |  | balance | stock |  | 其他流动资产 |
long_term_investments | 长期股权投资 |  | balance | stock |  | 长期股权投资;长期投资 |
fixed_assets | 固定资产 |  | balance | stock |  | 固定资产 |
construction_in_progress | 在建工程 |  | balance | stock |  | 在建工程 |
intangible_assets | 无形资产 |  | balance | stock |  | 无形资产 |
goodwill | 商誉 |  | balance | stock |  | 商誉 |
biological_assets | 生产性生物资产 |  | balance | stock |  | 生产性生物资产 |
right_of_use_assets | 使用权资产 |  | balance | stock |  | 使用权资产 |
long_term_prepaid_expenses | 长期待摊费用 |  | balance | stock |  | 长期待摊费用 |
other_noncurrent_assets | 其他非流动资产 |  | balance | stock |  | 其他非流动资产 |
noncurrent_assets_total | 非流动资产合计 |  | balance | stock |  | 非流动资产合计 |
total_assets | 资产总计 |  | balance | stock |  | 资产总计;资产总额 |
short_term_borrowings | 短期借款 |  | balance | stock |  | 短期借款 |
mortgage_loan | 抵押借款 | Mortgage Loan | balance | stock | short_term_borrowings | 抵押借款 | 抵押借款
guaranteed_loan | 保证借款 | Guaranteed Loan | balance | stock | short_term_borrowings | 保证借款 | 保证借款
credit_loan | 信用借款 | Credit Loan | balance | stock | short_term_borrowings | 信用借款 | 信用借款
notes_payable | 应付票据 |  | balance | stock |  | 应付票据 |
accounts_payable | 应付账款 |  | balance | stock |  | 应付账款 |
contract_liabilities | 合同负债 |  | balance | stock |  | 合同负债;预收款项 |
payroll_payable | 应付职工薪酬 |  | balance | stock |  | 应付职工薪酬 |
taxes_payable | 应交税费 |  | balance | stock |  | 应交税费 |
other_payables | 其他应付款 |  | balance | stock |  | 其他应付款 |
dividends_payable | 应付股利 |  | balance | stock | other_payables | 应付股利 |
current_portion_noncurrent_liabilities | 一年内到期的非流动负债 |  | balance | stock |  | 一年内到期的非流动负债 |
other_current_liabilities | 其他流动负债 |  | balance | stock |  | 其他流动负债 |
current_liabilities_total | 流动负债合计 |  | balance | stock |  | 流动负债合计;流动负债总计 |
long_term_borrowings | 长期借款 |  | balance | stock |  | 长期借款 |
long_term_payables | 长期应付款 |  | balance | stock |  | 长期应付款 |
bonds_payable | 应付债券 |  | balance | stock |  | 应付债券 |
lease_liability | 租赁负债 |  | balance | stock |  | 租赁负债 |
deferred_income | 递延收益 |  | balance | stock |  | 递延收益 |
noncurrent_liabilities_total | 非流动负债合计 |  | balance | stock |  | 非流动负债合计;非流动负债总计 |
total_liabilities | 负债合计 |  | balance | stock |  | 负债合计;负债总计 |
paid_in_capital | 实收资本 |  | balance | stock |  | 实收资本;股本 | 股本
capital_reserve | 资本公积 |  | balance | stock |  | 资本公积 |
share_premium | 股本溢价 | Share Premium | balance | stock | capital_reserve | 股本溢价 |
retained_earnings | 未分配利润 |  | balance | stock |  | 未分配利润 |
surplus_reserve | 盈余公积 |  | balance | stock |  | 盈余公积 |
other_equity_instruments | 其他权益工具 |  | balance | stock |  | 其他权益工具 |
other_equity_investments | 其他权益工具投资 |  | balance | stock |  | 其他权益工具投资 |
investment_property | 投资性房地产 |  | balance | stock |  | 投资性房地产 |
treasury_stock | 库存股 |  | balance | stock |  | 库存股 |
other_comprehensive_income | 其他综合收益 |  | balance | stock |  | 其他综合收益 |
total_equity_parent | 归属于母公司股东权益合计 |  | balance | stock |  | 归属于母公司股东权益合计;归属于母公司所有者权益合计 |
total_equity | 所有者权益合计 |  | balance | stock |  | 所有者权益合计;股东权益合计;权益合计 |
minority_interest | 少数股东权益 |  | balance | stock |  | 少数股东权益;少数股东权益合计 |
total_liabilities_equity | 负债和所有者权益总计 |  | balance | stock |  | 负债和所有者权益总计 |
net_cash_flow_operating | 经营活动产生的现金流量净额 |  | cashflow | flow |  | 经营活动产生的现金流量净额;经营活动现金流量净额 |
cash_received_from_sales | 销售商品、提供劳务收到的现金 |  | cashflow | flow |  | 销售商品、提供劳务收到的现金 |
cash_paid_for_goods | 购买商品、接受劳务支付的现金 |  | cashflow | flow |  | 购买商品、接受劳务支付的现金 |
cash_received_other_operating | 收到其他与经营活动有关的现金 |  | cashflow | flow |  | 收到其他与经营活动有关的现金 |
tax_refund_received | 收到的税费返还 |  | cashflow | flow |  | 收到的税费返还 |
cash_paid_to_employees | 支付给职工以及为职工支付的现金 |  | cashflow | flow |  | 支付给职工以及为职工支付的现金 |
taxes_paid | 支付的各项税费 |  | cashflow | flow |  | 支付的各项税费 |
cash_paid_other_operating | 支付其他与经营活动有关的现金 |  | cashflow | flow |  | 支付其他与经营活动有关的现金 |
operating_receivables_change | 经营性应收项目变动 |  | cashflow | flow |  | 经营性应收项目的减少;经营性应收项目的增加 |
operating_payables_change | 经营性应付项目变动 |  | cashflow | flow |  | 经营性应付项目的增加;经营性应付项目的减少 |
inventory_change | 存货变动 |  | cashflow | flow |  | 存货的减少;存货的增加 |
deferred_tax_assets_change | 递延所得税资产变动 |  | cashflow | flow |  | 递延所得税资产减少;递延所得税资产增加 |
operating_cash_inflows_subtotal | 经营活动现金流入小计 |  | cashflow | flow |  | 经营活动现金流入小计 |
operating_cash_outflows_subtotal | 经营活动现金流出小计 |  | cashflow | flow |  | 经营活动现金流出小计 |
net_cash_flow_investing | 投资活动产生的现金流量净额 |  | cashflow | flow |  | 投资活动产生的现金流量净额 |
cash_received_from_investments | 收回投资收到的现金 |  | cashflow | flow |  | 收回投资收到的现金 |
cash_received_from_investment_income | 取得投资收益收到的现金 |  | cashflow | flow |  | 取得投资收益收到的现金 |
cash_received_from_disposal_long_term_assets | 处置长期资产收回的现金净额 |  | cashflow | flow |  | 处置固定资产;处置无形资产;资产收回的现金净额;处置固定资产、无形资产和其他长期资产收回的现金净额 |
investing_cash_inflows_subtotal | 投资活动现金流入小计 |  | cashflow | flow |  | 投资活动现金流入小计 |
cash_paid_for_long_term_assets | 购建长期资产支付的现金 |  | cashflow | flow |  | 购建固定资产;购建无形资产;资产支付的现金;购建固定资产、无形资产和其他长期资产支付的现金 |
cash_paid_for_investments | 投资支付的现金 |  | cashflow | flow |  | 投资支付的现金 |
cash_paid_other_investing | 支付其他与投资活动有关的现金 |  | cashflow | flow |  | 支付其他与投资活动有关的现金 |
investing_cash_outflows_subtotal | 投资活动现金流出小计 |  | cashflow | flow |  | 投资活动现金流出小计 |
net_cash_flow_financing | 筹资活动产生的现金流量净额 |  | cashflow | flow |  | 筹资活动产生的现金流量净额 |
cash_received_from_borrowings | 取得借款收到的现金 |  | cashflow | flow |  | 取得借款收到的现金 |
cash_received_other_financing | 收到其他与筹资活动有关的现金 |  | cashflow | flow |  | 收到其他与筹资活动有关的现金;子公司吸收少数股东投资收到的现金 |
financing_cash_inflows_subtotal | 筹资活动现金流入小计 |  | cashflow | flow |  | 筹资活动现金流入小计 |
cash_paid_for_debt | 偿还债务支付的现金 |  | cashflow | flow |  | 偿还债务支付的现金 |
cash_paid_other_financing | 支付其他与筹资活动有关的现金 |  | cashflow | flow |  | 支付其他与筹资活动有关的现金;子公司支付给少数股东的股利、利润 |
cash_received_from_capital_contributions | 吸收投资收到的现金 |  | cashflow | flow |  | 吸收投资收到的现金 |
cash_paid_dividends_interest | 分配股利、利润或偿付利息支付的现金 |  | cashflow | flow |  | 分配股利、利润或偿付利息支付的现金 |
cash_flow_hedge_reserve | 现金流量套期储备 |  | income | flow |  | 现金流量套期储备 |
financing_cash_outflows_subtotal | 筹资活动现金流出小计 |  | cashflow | flow |  | 筹资活动现金流出小计 |
net_increase_cash | 现金及现金等价物净增加额 |  | cashflow | flow |  | 现金及现金等价物净增加额 |
fx_effect_on_cash | 汇率变动对现金及现金等价物的影响 |  | cashflow | flow |  | 汇率变动对现金及现金等价物的影响;汇率变动对现金及现金等价物的影响额 |
cash_begin | 期初现金及现金等价物余额 |  | cashflow | stock |  | 期初现金及现金等价物余额;现金的期初余额 |
cash_end | 期末现金及现金等价物余额 |  | cashflow | stock |  | 期末现金及现金等价物余额;现金的期末余额 |
depreciation_amortization | 折旧及摊销 |  | cashflow | flow |  | 折旧及摊销;固定资产折旧、油气资产折耗、生产性生物资产折旧;投资性房地产折旧;使用权资产折旧;无形资产摊销;长期待摊费用摊销 |
asset_impairment_provision | 资产减值准备 |  | cashflow | flow |  | 资产减值准备 |
"""

FIELDS = ("metric_code", "metric_name_cn", "metric_name_en", "statement_type", "value_nature", "parent_metric_code")


def base_metric_rows():
    """The dictionary as plain records, ``def_order`` starting at 0."""
    records = []
    for order, line in enumerate(BASE_METRICS.strip().splitlines()):
        parts = [part.strip() for part in line.split("|")]
        parts += [""] * (8 - len(parts))
        record = {name: value or None for name, value in zip(FIELDS, parts)}
        record["def_order"] = order
        record["patterns"] = [p for p in parts[6].split(";") if p]
        record["patterns_exact"] = [p for p in parts[7].split(";") if p]
        record["patterns_en"] = []
        record["patterns_en_exact"] = []
        records.append(record)
    return records
